"""Readers, writers, parameters and the command line, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from chronograph.operators.graph import TemporalGraph
from chronograph.plans import pipelines
from chronograph.plans.config import Params, arguments
from chronograph.sources import generators, graphs, sinks

RNG = random.Random(9)
ROWS = [(RNG.choice((0, 0, 2, 3, 7, 8, 9, 13)), RNG.choice((0, 1, 2, 4, 6, 7, 13)), float(RNG.randrange(1, 255))) for _ in range(256)]
LEAST = {}
for s, t, w in ROWS:
    if s != t:
        LEAST[s, t] = min(w, LEAST.get((s, t), w))


def metis(weighted):
    lines = [f"14 {len(LEAST)} {1 if weighted else 100}", "% a comment"]
    for v in range(14):
        lines.append(" ".join(f"{t + 1} {w:.0f}" if weighted else str(t + 1) for (s, t), w in LEAST.items() if s == v))
    return "\n".join(lines) + "\n"


FORMS = {
    "a.el": "".join(f"{s} {t}\n" for s, t, _ in ROWS),
    "b.wel": "\n".join(f"{s}\t{t}  {w}" for s, t, w in ROWS) + "\n\n",
    "c.gr": "c x\r\np sp 14 256\r\n" + "".join(f"a {s + 1} {t + 1} {w:.0f}\r\n" for s, t, w in ROWS),
    "d.graph": metis(False),
    "e.graph": metis(True),
    "f.mtx": f"%%MatrixMarket matrix coordinate pattern general\n% x\n14 14 {len(ROWS)}\n" + "".join(f"{s + 1} {t + 1}\n" for s, t, _ in ROWS),
    "g.mtx": f"%%MatrixMarket matrix coordinate integer general\n14 14 {len(ROWS)}\n" + "".join(f"{s + 1} {t + 1} {w:.0f}\n" for s, t, w in ROWS),
}


@pytest.mark.parametrize("split", [128 << 20, 300])
@pytest.mark.parametrize("name", sorted(FORMS))
def test_seven_forms_of_one_graph(spark, tmp_path, name, split):
    (tmp_path / name).write_text(FORMS[name], newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        g = TemporalGraph.from_edges(graphs.load(spark, str(tmp_path / name)), dedup=True)
        got = {(r["src"], r["dst"]): r["ts"] for r in g.edges.collect()}
        assert set(got) == set(LEAST) and g.describe() == f"Graph has 14 nodes and {len(LEAST)} directed edges for degree: {len(LEAST) // 14}"
        if name[0] in "bceg":
            assert got == LEAST
        else:
            assert all(1 <= t <= 255 and t == int(t) for t in got.values())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name, text, message", [
    ("x.graph", "3 2 11\n2\n1\n\n", "unsupported METIS format"), ("x.graph", "", "no METIS header"), ("x.mtx", "1 1 1\n", "no MatrixMarket banner"),
    ("x.mtx", "%%MatrixMarket matrix array real general\n", "coordinate"), ("x.mtx", "%%MatrixMarket matrix coordinate complex general\n", "complex"),
    ("x.mtx", "%%MatrixMarket matrix coordinate real general\n2 3 1\n", "not square"), ("x.txt", "1 2\n", "unknown suffix"), ("x", "", "no suffix"),
])
def test_refused_files(spark, tmp_path, name, text, message):
    (tmp_path / name).write_text(text)
    with pytest.raises(graphs.FormatError, match=message):
        graphs.read(spark, str(tmp_path / name)).collect()


def test_raw_temporal_lines(spark, tmp_path):
    (tmp_path / "r").write_text("1 2 30\n4 5 1 60\n\n")
    assert [tuple(r)[1:] for r in graphs.read_raw_temporal(spark, str(tmp_path / "r")).collect()] == [(1, 2, 30.0), (4, 5, 60.0)]
    (tmp_path / "r").write_text("1 2\n")
    with pytest.raises(Exception, match="3 or 4 numbers"):
        graphs.read_raw_temporal(spark, str(tmp_path / "r")).collect()


def test_snapshots(spark, tmp_path):
    adjs = np.zeros((4, 3, 3), int)
    adjs[1, 0, 2] = adjs[3, 2, 1] = 1
    np.savez(tmp_path / "s.npz", adjs=adjs, labels=np.eye(3, dtype=int)[[2, 0, 1]])
    edges, labels = graphs.read_snapshots(spark, str(tmp_path / "s.npz"))
    assert Counter((r["src"], r["dst"], r["ts"]) for r in edges.collect()) == Counter([(0, 2, 0.25), (2, 1, 0.75)])
    assert {r["node"]: r["label"] for r in labels.collect()} == {0: 2, 1: 0, 2: 1}


def test_printed_graph(spark):
    e = spark.createDataFrame([(0, 0, 2, 2.0), (1, 0, 1, 1.0), (2, 1, 0, 5.0)], "eid long, src long, dst long, ts double")
    from chronograph.operators.graph import adjacency

    assert {r["src"]: r["line"] for r in sinks.topology(adjacency(e)).collect()} == {0: "0: 1 2", 1: "1: 0"}
    assert sinks.neighbors(adjacency(e), 0) == ["1 1.0", "2 2.0"]
    with pytest.raises(ValueError, match="path"):
        sinks.write_edges(e, "")


def test_generators(spark):
    wide = generators.uniform_edges(spark, 40, 1).where("eid < 2000").select("src").collect()
    assert len({r[0] % 256 for r in wide}) > 200 and max(r[0] for r in wide) > 1 << 38
    with pytest.raises(ValueError, match="scale"):
        generators.rmat_edges(spark, 41)


def test_parameters():
    p = Params.parse("# all\nlearning_rate = 0.05\nwalk_length 7 # steps\nworkers 4\n")
    assert (p.learning_rate, p.walk_length, p.num_workers, p.num_epochs) == (0.05, 7, 4, 50)
    for bad in ("nonsense 1", "walk_length"):
        with pytest.raises(ValueError, match="line 1"):
            Params.parse(bad)


@pytest.mark.parametrize("argv", [["walk"], ["walk", "-f", "x", "-u", "4"], ["link", "-u", "4", "-r", "1"], ["node", "-u", "4"], ["other", "-u", "4"]])
def test_refused_options(argv):
    with pytest.raises(SystemExit):
        arguments(argv)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.wel").write_text(FORMS["b.wel"])
    (tmp_path / "p.txt").write_text("num_walks_per_node 2\nwalk_length 3\n")
    pipelines.main(["walk", "-f", str(tmp_path / "g.wel"), "-c", str(tmp_path / "p.txt"), "-v", "-a", "-n", "2", "-r", "0"])
    out = capsys.readouterr().out
    assert "14 nodes" in out and "every step is a later edge" in out and "walk 2:" in out and "mean of a walk trial" in out
    pipelines.main(["convert", "-u", "4", "-k", "3", "-a", "-e", str(tmp_path / "o.wel"), "-b", str(tmp_path / "o.parquet"), "-w"])
    assert "16 nodes and 48 undirected" in capsys.readouterr().out
    pairs = lambda name: Counter((r["src"], r["dst"], r["ts"]) for r in graphs.read(spark, str(tmp_path / name)).collect())
    assert pairs("o.wel") == pairs("o.parquet") and sum(pairs("o.wel").values()) == 96


def test_a_wrong_walk_is_found(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (1, 1, 2, 2.0)], "eid long, src long, dst long, ts double")
    steps = spark.createDataFrame([(0, 0, 0, 0, 0.0), (0, 0, 1, 1, 1.0), (0, 0, 2, 2, 1.5)], "walk int, start long, step int, node long, ts double")
    with pytest.raises(ValueError, match="step 2"):
        pipelines.verified(steps, e)
