"""Readers and structure on a small multigraph, against plain Python."""

from collections import Counter

import pytest

from chronograph.operators import graph, metrics, walk
from chronograph.sources import graphs

EDGES = [(0, 1, 5.0), (0, 1, 2.0), (1, 2, 3.0), (2, 2, 9.0), (4, 0, 1.0), (0, 1, 2.0)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EDGES)], "eid long, src long, dst long, ts double")


def rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("suffix, text", [
    ("wel", "".join(f"{a} {b} {t}\n" for a, b, t in EDGES)),
    ("gr", "c note\np sp 5 6\n" + "".join(f"a {a + 1} {b + 1} {t}\n" for a, b, t in EDGES)),
])
def test_readers_agree(spark, tmp_path, suffix, text):
    path = tmp_path / f"g.{suffix}"
    path.write_text(text)
    assert rows(graphs.read(spark, str(path)), "src", "dst", "ts") == Counter(EDGES)


def test_malformed_row_is_an_error(spark, tmp_path):
    (tmp_path / "g.wel").write_text("0 x 1\n")
    with pytest.raises(Exception, match="not a vertex"):
        graphs.read(spark, str(tmp_path / "g.wel")).collect()


def test_structure(edges):
    assert rows(graph.degrees(edges), "node", "degree") == Counter([(0, 3), (1, 1), (2, 1), (3, 0), (4, 1)])
    assert rows(graph.squish(edges), "src", "dst", "ts") == Counter([(0, 1, 2.0), (1, 2, 3.0), (4, 0, 1.0)])
    assert rows(graph.transposed(edges), "src", "dst", "ts") == Counter((b, a, t) for a, b, t in EDGES)
    assert graph.symmetrized(edges).count() == 2 * len(EDGES)


def test_walks_respect_time(edges):
    g = graph.normalized_times(edges)
    steps = walk.joined(g, 4, 3, 42).collect()
    seen = {}
    known = {(a, b) for a, b, _ in EDGES}
    for r in sorted(steps, key=lambda r: (r["walk"], r["start"], r["step"])):
        key = (r["walk"], r["start"])
        if key in seen:
            node, ts = seen[key]
            assert (node, r["node"]) in known and r["ts"] > ts
        seen[key] = (r["node"], r["ts"] if r["ts"] is not None else -1.0)


def test_auc_of_ties_and_of_a_perfect_ranking(spark):
    x = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9)], "y int, p double")
    assert list(metrics.roc_auc(x).first())[0] == pytest.approx(0.875)
