"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by its content (SHA-256). The ledger is a table of (rule_version, blob, findings),
a folder a rule version; a scan looks only at blobs that the ledger hasn't got for the rules in force, at one copy of each,
appends what it found, and joins findings back to all paths. Changed rules get another version by themselves.

Defined cases: a null text is empty; a null path is kept and gets its findings; equal texts are one blob, whatever their
number (one path's text is scanned, once for each row that repeats it); repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import new_path, read, staged, text_of

#: kind: pattern, the group whose length counts, its least length, and words of which a text holds one (in lower case) if it matches.
#: The first three are the base kinds; a match that is too short is dropped, but the search goes on after it.
RULES = {
    "assign": (r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, ("passw", "secret", "token", "api")),
    "access": (r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    "hex": (r"[0-9a-f]{16,}", 0, 16, ()),  # all of a run is one match, so the length can stand in the pattern
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0, 0, ("-----begin",)),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, ("eyj",)),
    "hosting": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("gh",)),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, ("xox",)),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
FINDING = "array<struct<kind: string, start: int, end: int>>"
_COMPILED = {kind: (re.compile(p), *rest) for kind, (p, *rest) in RULES.items()}


def find(text: str) -> list[tuple[str, int, int]]:
    """Matches by start, then in the order of RULES; code points, end exclusive."""
    found, lower = [], text.lower()
    for at, (kind, (pattern, group, least, hints)) in enumerate(_COMPILED.items()):
        if not hints or any(h in lower for h in hints):
            found += [(m.start(), at, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(b.column("text")[i].as_py())] for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], ["blob", "findings"])


class Ledger:
    """The table of scanned blobs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> None:
        self.spark, self.at = spark, f"{path}/rule_version={rule_version}"

    def rows(self) -> DataFrame:
        """blob and findings under these rules; one row a blob, also if a run was repeated."""
        schema = f"blob binary, findings {FINDING}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.at).dropDuplicates(["blob"])

    def scan(self, history: DataFrame) -> DataFrame:
        """Scans what is new in history (path, text) and returns path, blob and findings of all of it."""
        versions = history.select("path", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("blob"), text_of().alias("text"))
        paths = staged(versions.select("path", "blob"), "paths")
        first = paths.groupBy("blob").agg(F.min("path").alias("path"))
        unseen = first.join(self.rows(), "blob", "left_anti")
        new = versions.alias("v").join(unseen.alias("u"), F.expr("v.path <=> u.path and v.blob = u.blob"), "left_semi").select("blob", "text")
        found = new.mapInArrow(_scan, f"blob binary, findings {FINDING}")
        found.write.option("compression", "zstd").parquet(f"{self.at}/run={uuid.uuid4().hex}")
        # most blobs have no finding: only the others take part in the join, as a table, so that Spark can split hot blobs
        some = staged(self.rows().where(F.size("findings") > 0), "found")
        return paths.join(some, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of the ledger's rows."""
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return scanned.select(F.col("path").alias("doc_id"), *(count(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("findings").alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return digest(Ledger(spark, new_path(spark, "ledger")).scan(docs))


#: DuckDB's regular expressions give no places of matches.
ORACLE_SQL = None
