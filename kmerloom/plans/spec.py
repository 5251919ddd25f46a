"""The hash specification that an index carries: k, number of hashes, filter bits, hash family and parts of the storage."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


#: Letters of the longest k-mer that is a long.
LONG_K = 31


@dataclass(frozen=True)
class HashSpec:
    k: int = 20
    nh: int = 1
    m: int = 1 << 20
    family: str = ""
    seed: int = 0
    parts: int = 256

    def __post_init__(self):
        """The family, where none is named, is the one that k allows: universal hashes are of k-mers that are longs."""
        if not self.family:
            object.__setattr__(self, "family", "universal" if self.k <= LONG_K else "xxhash64")
        if min(self.k, self.nh, self.m, self.parts) < 1 or self.family not in ("universal", "xxhash64") or (self.family == "universal" and self.k > LONG_K):
            raise ValueError(f"not a hash specification: {self}")

    @property
    def span(self) -> int:
        """Positions of one part: filters are stored in `parts` equal ranges of positions."""
        return -(-self.m // self.parts)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write as one JSON file with Spark's own writer, so that any file system works."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashSpec:
        return cls(**json.loads(spark.read.text(path).first()[0]))
