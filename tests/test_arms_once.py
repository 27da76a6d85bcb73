"""The arms of the fidelity ranking come from one reading of the cells."""

from catalog import arms, flagship, ranks


def test_the_ranking_reads_the_cells_once_for_all_arms(spark, sf, monkeypatch):
    taken, given = [], flagship.canonical_cells

    def counted(*args):
        taken.append(args)
        return given(*args)

    monkeypatch.setattr(flagship, "canonical_cells", counted)
    monkeypatch.setattr(arms, "canonical_cells", counted)
    monkeypatch.setattr(ranks, "stored", lambda spark, sf, name, build: build())
    found = ranks.fidelity_arms(spark, sf)
    assert len(taken) == 1  # two with the members stacked on the filled cells
    assert found.columns[:4] == ["cohort", "design", "alpha", "method"]
