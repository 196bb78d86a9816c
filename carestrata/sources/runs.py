"""Tables that grow by small numbered runs, merged as they pile up, and an index of keys kept that way."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carestrata.sources.files import SharedFiles


class RunLog:
    """Runs under ``directory`` and the list of those that count, in ``_log``.

    A run is written first and counts once a new version of the list names it; versions are small files that
    appear whole and only once. Run ``n`` counts once, however often it is added. ``fan`` runs of one level are
    merged into one of the next, so a log of n runs keeps fewer than ``fan`` runs per level and about log n levels. A
    crash before a version is there changes nothing: the runs it would have replaced still count. Folders that a
    version replaces are removed by the next merge, so whoever reads a list has until then.

    A directory belongs to one writer's sequence of numbers (one checkpoint); two attempts of a number may race.
    """

    def __init__(self, spark: SparkSession, directory: str, fan: int = 8, folder: str = "update"):
        self.spark, self.directory, self.fan, self.folder = spark, directory, fan, folder
        self.files = SharedFiles(spark)

    def _version(self) -> tuple[int, dict]:
        names = [n for n in self.files.names(f"{self.directory}/_log") if n.startswith("v-")]
        if not names:
            return 0, {"runs": [], "replaced": []}
        return int(names[-1][2:12]), json.loads(self.files.read(f"{self.directory}/_log/{names[-1]}"))

    def _commit(self, number: int, content: dict) -> bool:
        done = self.files.put_new(f"{self.directory}/_log/v-{number:010d}.json", json.dumps(content))
        if done and number > 3:  # versions before the last ones are history
            self.files.remove(f"{self.directory}/_log/v-{number - 3:010d}.json")
        return done

    def runs(self, below: int | None = None) -> list[dict]:
        """The runs that count: folder, level, first and last number, and what the writer noted."""
        return [r for r in self._version()[1]["runs"] if below is None or r["last"] < below]

    def path(self, run: dict) -> str:
        return f"{self.directory}/{run['folder']}"

    def covers(self, n: int) -> bool:
        return any(r["first"] <= n <= r["last"] for r in self.runs())

    def _new_folder(self, first: int, last: int) -> str:
        return f"{self.folder}={first}-{last}-{uuid.uuid4().hex[:12]}"

    def add(self, n: int, write: Callable[[str], dict]) -> bool:
        """Let ``write`` fill a new folder and count it as run n; False if n counted already."""
        if self.covers(n):
            return False
        folder = self._new_folder(n, n)
        note = write(f"{self.directory}/{folder}")
        while True:
            number, content = self._version()
            if any(r["first"] <= n <= r["last"] for r in content["runs"]):
                self.files.remove(f"{self.directory}/{folder}")
                return False
            runs = [*content["runs"], {"folder": folder, "level": 0, "first": n, "last": n, **note}]
            if self._commit(number + 1, {"runs": runs, "replaced": content["replaced"]}):
                return True

    def compact(self, merge: Callable[[list[dict], str], dict], below: int | None = None) -> int:
        """Merge as long as some level has ``fan`` runs; ``merge`` reads the given runs and fills a new folder.

        Gives the number of merges. ``below`` leaves runs from that number on alone: their writer may come back.
        """
        merges = 0
        while True:
            number, content = self._version()
            levels: dict[int, list[dict]] = {}
            for run in content["runs"]:
                if below is None or run["last"] < below:
                    levels.setdefault(run["level"], []).append(run)
            full = next((runs for _, runs in sorted(levels.items()) if len(runs) >= self.fan), None)
            if full is None:
                return merges
            first, last = min(r["first"] for r in full), max(r["last"] for r in full)
            folder = self._new_folder(first, last)
            note = merge(full, f"{self.directory}/{folder}")
            merged = {"folder": folder, "level": full[0]["level"] + 1, "first": first, "last": last, **note}
            rest = [r for r in content["runs"] if r not in full]
            if not self._commit(number + 1, {"runs": [*rest, merged], "replaced": [r["folder"] for r in full]}):
                self.files.remove(f"{self.directory}/{folder}")
                continue
            for old in content["replaced"]:
                self.files.remove(f"{self.directory}/{old}")
            merges += 1


class KeyIndex:
    """Keys seen so far, in runs of slices with a Bloom filter each.

    A key's slice is a part of its hash; a run has as many slices as make about ``slice_keys`` keys each. A lookup
    reads the filters of the slices its keys fall into, and opens only the slices where a filter says that one of
    them may be there; hits are compared with the keys themselves.
    """

    PROBES = 4
    BITS_PER_KEY = 12

    def __init__(self, spark: SparkSession, directory: str, slice_keys: int = 50_000, fan: int = 8):
        self.spark, self.slice_keys = spark, slice_keys
        self.log = RunLog(spark, directory, fan, "run")
        self.opened: list[tuple[str, int]] = []  # slices that the last lookup opened

    @staticmethod
    def _slice(key: Column, slices: Column) -> Column:
        return F.pmod(F.xxhash64(key), slices)

    def _bits(self, key: Column, bits: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(i)), bits) for i in range(1, self.PROBES + 1)]

    def _write(self, keys: DataFrame, path: str) -> dict:
        """Distinct keys as slices, and the filters of the slices."""
        flat = f"{path}/flat"
        keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct().write.parquet(flat)
        flat_keys = self.spark.read.schema("key string").parquet(flat)
        rows = flat_keys.count()
        slices = max(1, -(-rows // self.slice_keys))
        bits = 64 * max(1, -(-rows * self.BITS_PER_KEY // (64 * slices)))
        sliced = flat_keys.withColumn("slice", self._slice(F.col("key"), F.lit(slices)))
        sliced.repartitionByRange("slice", "key").sortWithinPartitions("slice", "key").write.partitionBy("slice").parquet(
            f"{path}/keys")
        words = (sliced.select("slice", F.explode(F.array(*self._bits(F.col("key"), F.lit(bits)))).alias("bit"))
                 .groupBy("slice", F.expr("bit div 64").alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")))
        (words.groupBy("slice").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
         .repartitionByRange("slice").sortWithinPartitions("slice").write.parquet(f"{path}/filters"))
        self.log.files.remove(flat)
        return {"rows": rows, "slices": slices, "bits": bits}

    def add(self, n: int, keys: DataFrame) -> bool:
        """Add the keys (a column ``key``, nulls left out) as run n; once."""
        return self.log.add(n, lambda path: self._write(keys, path))

    def compact(self, below: int | None = None) -> int:
        def merge(runs: list[dict], path: str) -> dict:
            paths = [f"{self.log.path(r)}/keys" for r in runs if r["rows"]]
            whole = self.spark.createDataFrame([], "key string")
            for p in paths:
                whole = whole.union(self.spark.read.schema("key string, slice long").parquet(p).select("key"))
            return self._write(whole, path)

        return self.log.compact(merge, below)

    def known(self, keys: DataFrame, below: int | None = None) -> DataFrame:
        """Those of the keys (column ``key``) that runs before number ``below`` hold."""
        runs = [r for r in self.log.runs(below) if r["rows"]]
        self.opened = []
        wanted = keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct()
        nothing = self.spark.createDataFrame([], "key string")
        if not runs:
            return nothing
        at = None
        for i, run in enumerate(runs):
            filters = self.spark.read.schema("slice long, words map<long,long>").parquet(f"{self.log.path(run)}/filters")
            probes = self._bits(F.col("key"), F.lit(run["bits"]))
            held = F.lit(True)
            for bit in probes:
                word = F.coalesce(F.element_at("words", F.call_function("div", bit, F.lit(64))), F.lit(0).cast("bigint"))
                held = held & (F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1)
            hits = (wanted.withColumn("slice", self._slice(F.col("key"), F.lit(run["slices"]))).join(filters, "slice")
                    .filter(held).select(F.lit(i).alias("run"), "slice").distinct())
            at = hits if at is None else at.union(hits)
        # numbers of slices only: at most one per wanted key and run
        self.opened = sorted((runs[r["run"]]["folder"], r["slice"]) for r in at.collect())
        paths = [f"{self.log.directory}/{folder}/keys/slice={s}" for folder, s in self.opened]
        if not paths:
            return nothing
        return wanted.join(self.spark.read.schema("key string").parquet(*paths), "key", "left_semi")
