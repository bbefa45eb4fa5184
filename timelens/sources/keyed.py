"""Keyed table: first row of a key stays, an append reads and writes only the leaves that its keys fall into."""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import first_per_key, null_safe_join
from ..session import materialize

#: Rows of a leaf beyond which it is split, and folders of a leaf beyond which they become one.
SPLIT_ROWS, COMPACT_AT = 2_000_000, 8


class KeyedTable:
    """Rows with a unique key in leaves of a digest trie, named by versions of one manifest.

    A leaf holds the keys whose digest ends in given bits. Its rows lie in a few folders; an append adds one, a leaf with many
    folders is rewritten as one, a leaf that has grown beyond ``split_rows`` is split by further bits. So an append reads
    the keys of touched leaves only, at most ``split_rows`` for each, however long the history is. Each version is one
    manifest file that exactly one writer can create: readers see all of an append or nothing, an append that is
    interrupted leaves the last version, and a writer that loses the race starts over from the winner's version.

    A null key is a key like others. Rows beside the columns of the schema are not kept; missing ones are null.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, split_rows: int = SPLIT_ROWS, compact_at: int = COMPACT_AT):
        if clash := {"_bits", "_tail", "_leaf", "_to"} & set(schema.names):
            raise ValueError(f"reserved column names: {sorted(clash)}")
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.split_rows, self.compact_at = split_rows, compact_at

    # ---------------------------------------------------------------- versions
    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The latest version: ``{"version", "batch", "leaves": [{"bits", "tail", "rows", "folders"}]}``."""
        folder, fs = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "batch": None, "leaves": [{"bits": 0, "tail": 0, "rows": 0, "folders": []}]}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/v{max(versions)}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> bool:
        """Publish a version whole; False if another writer has published that number."""
        text = json.dumps(manifest).encode()
        target, fs = self._hadoop(f"{self.path}/manifests/v{manifest['version']}.json")
        draft, _ = self._hadoop(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        if fs.getUri().getScheme() == "file":
            name = draft.toUri().getPath()
            with open(name, "wb") as f:
                f.write(text)
            try:
                os.link(name, target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(name)
        out = fs.create(draft, True)
        out.write(text)
        out.close()
        done = not fs.exists(target) and fs.rename(draft, target)  # a rename onto an existing file is refused
        if not done:
            fs.delete(draft, False)
        return done

    # ---------------------------------------------------------------- reading
    def _rows(self, folders: list[str], columns: list[str] | None = None) -> DataFrame:
        if not folders:
            df = self.spark.createDataFrame([], self.schema)
        else:
            df = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        return df.select(*columns) if columns else df

    def read(self) -> DataFrame:
        return self._rows([f for leaf in self.manifest()["leaves"] for f in leaf["folders"]])

    # ---------------------------------------------------------------- writing
    def _tail(self, bits: Column | int) -> Column:
        b = F.lit(bits) if isinstance(bits, int) else bits
        return F.xxhash64(F.col(self.key)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) - 1)

    def _in_leaves(self, df: DataFrame, leaves: list[dict]) -> DataFrame:
        """Rows with the (``_bits``, ``_tail``) of their leaf: each depth in use is tried, one of them exists."""
        depths = sorted({leaf["bits"] for leaf in leaves})
        tries = F.array(*[F.struct(F.lit(b).alias("_bits"), self._tail(b).alias("_tail")) for b in depths])
        known = self.spark.createDataFrame([(leaf["bits"], leaf["tail"]) for leaf in leaves], "_bits int, _tail long")
        return df.withColumn("_leaf", F.explode(tries)).select(*df.columns, "_leaf.*").join(known, ["_bits", "_tail"], "left_semi")

    def append(self, incoming: DataFrame, order: list[Column], batch: int | None = None) -> dict:
        """Add the rows whose key is new, the first by ``order`` of each; returns the version that then holds.

        ``batch`` numbers the batches of a stream: one that a version already contains is not applied again.
        """
        columns = [f.name for f in self.schema.fields]
        given = [F.col(f"`{f.name}`") if f.name in incoming.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        fresh = materialize(first_per_key(incoming.select(*given), [self.key], order), "keyed_batch")
        while True:
            old = self.manifest()
            if batch is not None and old["batch"] is not None and batch <= old["batch"]:
                return old
            new = self._next(old, fresh, columns, old["batch"] if batch is None else batch)
            if new is old or self._commit(new):
                return new

    def _next(self, old: dict, fresh: DataFrame, columns: list[str], batch: int | None) -> dict:
        placed = self._in_leaves(fresh, old["leaves"])
        name = {(leaf["bits"], leaf["tail"]): leaf for leaf in old["leaves"]}
        hit = [(r["_bits"], r["_tail"]) for r in placed.select("_bits", "_tail").distinct().collect()]  # at most one a leaf
        stored = self._rows([f for at in hit for f in name[at]["folders"]], [self.key])
        news = materialize(null_safe_join(placed, stored, [self.key], "left_anti"), "keyed_new")
        gain = {(r["_bits"], r["_tail"]): r["count"] for r in news.groupBy("_bits", "_tail").count().collect()}
        if not gain and batch == old["batch"]:
            return old
        to, again = [], []
        for at, n in gain.items():
            leaf = name[at]
            more = max(0, math.ceil(math.log2((leaf["rows"] + n) / self.split_rows)))
            rewrite = bool(leaf["folders"]) and (more > 0 or len(leaf["folders"]) >= self.compact_at)
            to.append((*at, at[0] + more))
            if rewrite or more:
                again.append(at)
        leaves = [leaf for leaf in old["leaves"] if (leaf["bits"], leaf["tail"]) not in again]
        leaves = {(leaf["bits"], leaf["tail"]): dict(leaf, folders=list(leaf["folders"])) for leaf in leaves}
        if to:
            bits = self.spark.createDataFrame(to, "_bits int, _tail long, _to int")
            moved = [leaf for at in again for leaf in [name[at]] if leaf["folders"]]
            kept = self._in_leaves(self._rows([f for leaf in moved for f in leaf["folders"]]), moved) if moved else None
            rows = news.unionByName(kept) if kept is not None else news
            rows = rows.join(bits, ["_bits", "_tail"]).select(*columns, F.col("_to").alias("_bits"), self._tail(F.col("_to")).alias("_tail"))
            folder = f"data/{uuid.uuid4().hex}"
            rows.repartition("_bits", "_tail").write.partitionBy("_bits", "_tail").parquet(f"{self.path}/{folder}")
            written = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_bits", "_tail").count()
            sizes = {(r["_bits"], r["_tail"]): r["count"] for r in written.collect()}
            # A split leaf gives all its parts to the trie, those without rows too.
            parts = {(b, t + (k << at)) for at, t, b in to for k in range(1 << (b - at))}
            for at in parts | set(sizes):
                leaf = leaves.setdefault(at, {"bits": at[0], "tail": at[1], "rows": 0, "folders": []})
                if at in sizes:
                    leaf["rows"] += sizes[at]
                    leaf["folders"].append(f"{folder}/_bits={at[0]}/_tail={at[1]}")
        return {"version": old["version"] + 1, "batch": batch, "leaves": sorted(leaves.values(), key=lambda f: (f["bits"], f["tail"]))}
