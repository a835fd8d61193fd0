"""What the steps of a mirror plan look at."""

from test_site import _small_site

from webstrata.operators import mirror


def test_only_visits_of_what_is_asked_for_are_laid_out_along_time(spark, monkeypatch):
    seen, real = [], mirror.nearest_join

    def spy(left, right, *args, **kwargs):
        seen.append((right.select("net_url").exceptAll(right.select("net_url").join(left.select("net_url"), "net_url", "left_semi")).count(), right.count()))
        return real(left, right, *args, **kwargs)

    monkeypatch.setattr(mirror, "nearest_join", spy)
    visits, pages, roots = _small_site(spark)
    assert {r.visit for r in mirror.plan(visits, pages, roots).saved.collect()} == {1, 4}
    assert seen and seen[0] == (0, 4) and all(not idle for idle, _ in seen)  # of nine
