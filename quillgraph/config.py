
from __future__ import annotations

import argparse
from dataclasses import dataclass, fields
from enum import Enum


class Popularity(str, Enum):
    """How the frequent terms are found."""

    EXACT = "exact"
    COUNT_MIN = "cms"
    TOPK_SKETCH = "topk_sketch"
    SAMPLE = "sample"


@dataclass(frozen=True)
class EncodeConfig:
    """Every option has a default.

    ``start_counter`` is the first id handed out; ``sketch_width`` 0 takes the width of count-min sketches from the size of the input. With
    ``mine_patterns`` sets of at most ``max_pattern_length`` classes that more than ``min_support`` terms share are found, siblings of the taxonomy are put
    in the order these suggest, and terms of a class are clustered by the classes of their neighbours. ``hash_ids`` makes ids of hashes instead of a
    dictionary with dense ids; the options of the latter have no effect then.
    """

    popularity: Popularity = Popularity.EXACT
    top_k: int = 1000
    min_freq: int = 1
    sample_per_10000: int = 500
    ignore_predicates: bool = False
    distinct: bool = True
    start_counter: int = 0
    sketch_width: int = 0
    mine_patterns: bool = False
    min_support: int = 1000
    max_pattern_length: int = 3
    permutations: int = 63
    write_taxonomy: bool = False
    hash_ids: bool = False
    log_level: str = "INFO"
    log_file: str = ""

    def __post_init__(self) -> None:
        if self.top_k < 0 or self.start_counter < 0:
            raise ValueError("top_k and start_counter must not be negative")
        if not 0 <= self.permutations <= 63:
            raise ValueError("permutations is a bit set of six orders: 0 to 63")
        if self.min_support < 0 or self.max_pattern_length < 1 or self.sketch_width < 0:
            raise ValueError("min_support and sketch_width must not be negative, max_pattern_length must be positive")
        if not 0 < self.sample_per_10000 <= 10000:
            raise ValueError("sample_per_10000 must be in 1..10000")


def parse_args(argv: list[str]) -> tuple[str, str, EncodeConfig]:
    """Command line of ``python -m quillgraph``: input path, output path, options."""
    p = argparse.ArgumentParser(prog="quillgraph", description="Encode a graph in N-Triples.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    for f in fields(EncodeConfig):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(flag, type=type(f.default), default=f.default)
    a = vars(p.parse_args(argv))
    return a.pop("input"), a.pop("output"), EncodeConfig(**a)
