"""Token counts kept as additive totals that batches of changes update.

A change gives a document's count under a tokenizer version, or takes it away. Against what is
known of the document it becomes signed rows: minus the old count, plus the new one. A batch
writes its signed rows, then their sums by source, language and version; the marker that the
last write leaves commits it. Totals are the sums over all committed batches. A batch that is
committed already is not applied again, one that broke off is written anew. Every few batches what
they come to is written as a snapshot, so a batch reads the documents as they are and the few
batches since, however many came before; of these only the rows it touches are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.llm import bpe
from likewise.llm import text as tx
from likewise.llm.sieve import sieve
from likewise.llm.workers import give_back

GROUP = ["source", "lang", "version"]

_LEDGER = "doc_id long, version string, source string, lang string, docs long, tokens long"
_TOTALS = "source string, lang string, version string, docs long, tokens long"


@dataclass(frozen=True)
class Rollup:
    """Totals in a folder that all executors share."""

    spark: SparkSession
    folder: str
    #: Batches after which what they come to is written as a snapshot.
    compact_every: int = 8

    def _numbers(self, pattern: str) -> list[int]:
        """The numbers in the names of the folders above the files of this pattern."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [f.getPath().toString() for f in found or []]
        return sorted(int(re.search(r"=(\d+)/[^=]*$", name).group(1)) for name in names)

    def _snapshot(self) -> tuple[str | None, list[int]]:
        """The folder of the last complete snapshot, and the batches that it holds."""
        complete = self._numbers("snapshot=*/batches/_SUCCESS")
        if not complete:
            return None, []
        folder = f"{self.folder}/snapshot={complete[-1]}"
        return folder, [r[0] for r in self.spark.read.parquet(f"{folder}/batches").collect()]

    def committed(self) -> list[int]:
        """The batches whose last write has left its marker."""
        return sorted({*self._snapshot()[1], *self._numbers("totals/batch=*/_SUCCESS")})

    def _read(self, part: str, schema: str) -> DataFrame:
        """The last snapshot's rows and those of the batches after it."""
        folder, held = self._snapshot()
        paths = [f"{self.folder}/{part}/batch={b}" for b in self.committed() if b not in held]
        if folder:
            paths.append(f"{folder}/{part}")
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def compact(self) -> None:
        """Write what all committed batches come to as one snapshot, from which reading starts.

        The list of its batches is written last and makes it count. Batches stay where they are,
        and one that is sent again is still known.
        """
        batches = self.committed()
        folder = f"{self.folder}/snapshot={len(batches)}"
        if not batches or folder == self._snapshot()[0]:
            return
        self.counts().select("doc_id", "version", "source", "lang", "docs", "tokens").write.mode(
            "overwrite"
        ).parquet(f"{folder}/ledger")
        self.totals().write.mode("overwrite").parquet(f"{folder}/totals")
        listed = self.spark.createDataFrame([(b,) for b in batches], "batch long").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{folder}/batches")

    def counts(self, of: DataFrame | None = None) -> DataFrame:
        """The documents as they are now: doc_id, version, source, lang, docs, tokens.

        With ``of``, distinct (doc_id, version), only these: other rows are put aside before
        anything is shuffled.
        """
        ledger = self._read("ledger", _LEDGER)
        if of is not None:
            key = ["doc_id", "version"]
            ledger = sieve(ledger, [ledger[k] for k in key], of, [of[k] for k in key])
            asked = of.withColumnsRenamed({k: f"_{k}" for k in key})
            same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("version").eqNullSafe(F.col("_version"))
            ledger = ledger.join(asked, same, "left_semi")
        return (
            ledger.groupBy("doc_id", *GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs != 0")
        )

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; groups without documents are left out."""
        return (
            self._read("totals", _TOTALS)
            .groupBy(*GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs != 0 OR tokens != 0")
        )

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before and nothing is done.

        ``changes`` has doc_id, version, source, lang, n_tokens and seq. A null ``n_tokens``
        deletes the document's count, any other sets it, whether it is new, revised or has
        moved to another source or language. Of several changes of a document and version the
        one with the largest seq counts, of equal ones the largest count. A null doc_id is a
        document like any other; null sources and languages are groups. Deleting what isn't
        there changes nothing. Other columns are not looked at.
        """
        if batch in self.committed():
            return False
        key = ["doc_id", "version"]
        last = changes.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "version").agg(
            F.max(F.struct("seq", "n_tokens", "source", "lang")).alias("new")
        )
        before = self.counts(last.select(*key))
        minus = before.select(*key, "source", "lang", -F.col("docs"), -F.col("tokens"))
        plus = last.where("new.n_tokens IS NOT NULL").select(
            *key,
            "new.source",
            "new.lang",
            F.lit(1).cast("bigint").alias("docs"),
            F.col("new.n_tokens").cast("bigint").alias("tokens"),
        )
        ledger = f"{self.folder}/ledger/batch={batch}"
        minus.union(plus).toDF("doc_id", "version", "source", "lang", "docs", "tokens").write.mode(
            "overwrite"
        ).parquet(ledger)
        sums = self.spark.read.schema(_LEDGER).parquet(ledger).groupBy(*GROUP)
        sums = sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")
        if len(self.committed()) % self.compact_every == 0:
            self.compact()
        return True


def word_count(text: Column) -> Column:
    """The tokens of the version "words": runs of anything but white space."""
    return tx.count_runs(tx.whole(text), r"[\x20\x09-\x0D]")


def bpe_count(docs: DataFrame, path: str, pattern: str, name: str) -> DataFrame:
    """``docs`` without its text, with the number of its byte-level BPE tokens as ``name``."""
    file = bpe._share(docs, path)
    tx.bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", name)]
    docs = docs.select("text", *others)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(bpe.vocabulary(SparkFiles.get(file)), pattern)
        for batch in batches:
            for a, b in bpe.blocks(batch.column(0)):
                part = batch.slice(a, b - a)
                sizes = pc.list_value_length(encoder.encode(part.column(0)))
                columns = [*part.columns[1:], sizes.cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, name])
            give_back()

    return docs.mapInArrow(of, bpe._schema(docs.select(*others), f"`{name}` long"))
