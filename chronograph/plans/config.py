"""Parameters of the pipelines: defaults, the ``key value`` file form, and command-line options."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """num_workers, num_threads, use_max_num_threads and num_batches are read for the files' sake: the cluster's executors
    and partitions take their place."""

    output_dim: int = 5
    learning_rate: float = 1.0
    num_epochs: int = 50
    hidden_dim: int = 100
    hidden_dim_1: int = 100
    hidden_dim_2: int = 100
    num_workers: int = 0
    training_ratio: float = 0.8
    node_embedding_dim: int = 128
    num_walks_per_node: int = 10
    num_threads: int = 48
    use_max_num_threads: int = 1
    walk_length: int = 5
    target: float = 0.75
    batch_size: int = 128
    num_batches: int = 10
    seed: int = 42

    @staticmethod
    def parse(text: str, base: Params | None = None) -> Params:
        """``key value`` lines; ``#`` starts a comment; unknown keys and missing values are errors."""
        known = {f.name: f for f in fields(Params)}
        out = {}
        for number, line in enumerate(text.splitlines(), 1):
            parts = line.partition("#")[0].replace("=", " ").split()
            if not parts:
                continue
            name = {"workers": "num_workers"}.get(parts[0], parts[0])
            if name not in known or len(parts) < 2:
                raise ValueError(f"line {number}: {line.strip()!r}")
            out[name] = float(parts[1]) if known[name].type == "float" else int(float(parts[1]))
        return replace(base or Params(), **out)

    @staticmethod
    def read(path: str) -> Params:
        with open(path) as f:
            return Params.parse(f.read())


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """One of a graph file and a generator scale is needed; a generated graph is symmetrised."""
    p = argparse.ArgumentParser(prog="chronograph")
    p.add_argument("command", choices=["link", "node", "convert", "walk"])
    p.add_argument("-f", "--file")
    p.add_argument("-s", "--symmetrize", action="store_true")
    p.add_argument("-g", "--kronecker", type=int, metavar="SCALE")
    p.add_argument("-u", "--uniform", type=int, metavar="SCALE")
    p.add_argument("-k", "--degree", type=int, default=16)
    p.add_argument("-c", "--params")
    p.add_argument("-p", "--labels", help="folder of train.tsv, valid.tsv and test.tsv")
    p.add_argument("-n", "--trials", type=int, default=1, help="walk: how often it is timed")
    p.add_argument("-r", "--node", type=int, help="walk: start at this vertex only")
    p.add_argument("-a", "--analysis", action="store_true", help="walk: print how many walks have each length; else the first rows of the graph's degrees")
    p.add_argument("-v", "--verify", action="store_true", help="check that every step of the walks is a later edge of the graph")
    p.add_argument("-e", "--edges", help="converter: text output")
    p.add_argument("-b", "--binary", help="converter: Parquet output")
    p.add_argument("-w", "--weighted", action="store_true")
    p.add_argument("--dedup", action="store_true")
    a = p.parse_args(argv)
    if a.command != "walk" and (a.node is not None or a.trials != 1):
        p.error("-r and -n belong to walk")
    if a.command == "node" and not a.labels:
        p.error("node needs -p")
    if sum(x is not None for x in (a.file, a.kronecker, a.uniform)) != 1:
        p.error("give one of -f, -g and -u")
    a.symmetrize = a.symmetrize or a.file is None
    return a
