"""Token counts as delta-maintained rollups.

A batch of signed deltas (insert +, delete -, revision = delete of the old count and insert of the
new) becomes additive totals by source, language and tokenizer version. A batch counts from the moment
its record gets its name, which one writer alone can give it: repeating a commit changes nothing, and a
half-written batch is never read. Totals are sums over batches; ``compact`` folds them into one.
Renames must be atomic, as on HDFS; an object store needs a committer that gives that.

Defined results: null texts count no tokens; null source, language or id is a group or row like any
other; deltas that cancel leave totals of zero documents out; an empty batch or table commits nothing
but its id; repeated rows count each; a very long text is counted whole; columns other than id, text,
source and language are not read.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map
from .packing import default_tokenizer, encoder

KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """source, lang, tokenizer, n_tokens: a row for each document and tokenizer version.

    tokenizers: version -> path of a ``tokenizers`` file; the version ``words`` counts words.
    """
    paths = tokenizers or {"byte_bpe_50k": ""}

    def make():
        counters = {v: (lambda t: len(t.split())) if v == "words" else (lambda t, e=encoder(p or default_tokenizer()): len(e(t))) for v, p in paths.items()}

        def work(batch):
            texts = batch["text"].to_pylist()
            n = len(counters)
            index = pa.array([i for i in range(len(texts)) for _ in range(n)], pa.int64())
            counts = [c(t) if t else 0 for t in texts for c in counters.values()]
            return pa.RecordBatch.from_arrays([*(batch[k].take(index) for k in ("doc_id", "source", "lang")),
                pa.array([*counters] * len(texts), pa.string()), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source",
        "lang"), make, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals kept in a folder that all executors share.

    ``data/`` holds written totals of batches and bases. What counts is said by records, small files that
    come to be by a rename which fails where the name is taken: ``commits/<id>`` names a batch's data,
    ``bases/<n>`` the data of base n and the ids that it folded. Folded commits move to ``folded/``, so that
    no list grows with the number of batches ever committed, and their ids stay taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _p(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._p().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(), self._p(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, *parts: str) -> dict:
        source = self._fs().open(self._p(*parts))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _record(self, value: dict, *parts: str) -> bool:
        """Puts a record in place; False where its name is taken, by whoever came first."""
        jvm, fs, staged = self.spark._jvm, self._fs(), self._p("staged", uuid.uuid4().hex)
        out = fs.create(staged, False)
        out.write(json.dumps(value).encode())
        out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(kinds, 1)
        plain[0] = kinds.valueOf("NONE")
        fs.mkdirs(self._p(*parts[:-1]))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, self._p(*parts), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(staged, False)
            return False
        return True

    def _write(self, deltas: DataFrame) -> str:
        name = uuid.uuid4().hex
        totals = deltas.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        totals.write.parquet(f"{self.path}/data/{name}")
        return name

    def _taken(self, name: str) -> bool:
        return any(self._fs().exists(self._p(folder, name)) for folder in ("commits", "folded"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch; False if a batch of that id was there."""
        name = quote(batch, safe="")
        if self._taken(name):
            return False
        data = self._write(deltas)
        if not self._record({"data": data}, "commits", name) or self._fs().exists(self._p("folded", name)):
            self._fs().delete(self._p("data", data), True)
            return False
        return True

    def _state(self) -> tuple[int, str | None, dict[str, str]]:
        """(number of the newest base, its data, data of each batch that it does not hold)."""
        while True:
            bases = self._names("bases")
            n = int(bases[-1]) if bases else 0
            base = self._read("bases", bases[-1]) if bases else {"data": None, "ids": []}
            held = set(base["ids"])
            try:
                live = {name: self._read("commits", name)["data"] for name in self._names("commits") if name not in held}
            except Py4JJavaError:  # a commit was folded between listing and reading
                live = None
            if live is not None and self._names("bases") == bases:
                return n, base["data"], live

    def _sum(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*(f"{self.path}/data/{n}" for n in parts)).select(*KEYS, "n_docs", "n_tokens")
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        _, base, live = self._state()
        return self._sum([*filter(None, [base]), *live.values()])

    def compact(self) -> bool:
        """Folds the newest base and the batches beside it into one; exactly those that were listed are
        summed. False where another call made the next base first; then nothing has changed."""
        n, base, live = self._state()
        self._move(n)
        data = self._write(self._sum([*filter(None, [base]), *live.values()]))
        if not self._record({"data": data, "ids": sorted(live)}, "bases", f"{n + 1:09d}"):
            self._fs().delete(self._p("data", data), True)
            return False
        self._move(n + 1)
        return True

    def _move(self, n: int) -> None:
        """Commits that base n folded go to ``folded/``; again after a stop halfway."""
        fs = self._fs()
        fs.mkdirs(self._p("folded"))
        for name in self._read("bases", f"{n:09d}")["ids"] if n else ():
            if fs.exists(self._p("commits", name)):
                fs.rename(self._p("commits", name), self._p("folded", name))

    def vacuum(self) -> None:
        """Deletes data that no record in force names; not beside a running commit, nor beside a reader of
        totals taken before the last ``compact``."""
        _, base, live = self._state()
        for name in set(self._names("data")) - {base, *live.values()}:
            self._fs().delete(self._p("data", name), True)
