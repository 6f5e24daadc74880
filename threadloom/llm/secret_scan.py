"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of every text is addressed by its SHA-256. The ledger holds, per blob and rule
version, the spans found, also when there are none. A scan reads only texts whose blob and
rule version the ledger lacks, each blob once however many paths hold it, adds its spans to
the ledger, and joins the ledger back to all paths.

Null texts count as empty ones. Repeated rows and several paths with one text give equal
spans. An empty table gives an empty one. Extra columns stay; those named like the results
are replaced. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, let, running
from threadloom.runtime import path_exists, scratch_path


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed values of the base rules: keys of assignments, alphabets and least lengths.
_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 12

#: A private key: from its BEGIN line to its END line or, without one, through the header lines and
#: runs of base64 that follow. Between lines may stand white space, quote marks and written \n.
_GAP = r"""[\s>|#*"',;+-]*+(?:\\[nrt][\s>|#*"',;+-]*+)*+"""
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-?-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*+)*+"
    rf"""(?:(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\s\\"',;]|$))?+)?+)"""
)

#: kind: (pattern, cheap literal or pattern that a text with a match contains)
RULES = {
    "assign": (ASSIGN, None),
    "access": (r"AKIA[A-Z0-9]{14,}", "AKIA"),
    "hex": (r"[0-9a-f]{16,}", None),
    "pem": (PEM, "PRIVATE KEY-----"),
    "hosted": (r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", "eyJ"),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "4"

_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _kind_spans(text: Column, kind: str) -> Column:
    """Spans of one rule: the lengths of the pieces between matches give the offsets."""
    pattern, literal = RULES[kind]
    number = list(RULES).index(kind)
    kept = (
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)
        if kind == "assign" else F.array().cast("array<boolean>")
    )

    def place(parts: Column) -> Column:
        stops = running(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, x: a + x)
        placed = F.zip_with(parts, stops, lambda p, stop: F.struct(
            (stop - p["size"]).alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), p["ok"].alias("ok")))
        return F.transform(F.filter(placed, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["kind"], s["stop"]))

    def located(bundle: Column) -> Column:
        parts = F.transform(bundle["hits"], lambda hit, i: F.struct(
            F.length(F.get(bundle["gaps"], i)).alias("gap"), F.length(hit).alias("size"),
            F.coalesce(F.get(bundle["ok"], i), F.lit(True)).alias("ok"),
        ))
        return let(parts, place)

    bundle = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.split(text, pattern, -1).alias("gaps"), kept.alias("ok"),
    )
    maybe = text.contains(literal) if literal else text.rlike(pattern)
    return F.when(maybe, let(bundle, located)).otherwise(F.array().cast(_SPANS))


def spans(text: Column) -> Column:
    """All spans of a text, sorted by start, then kind."""
    return F.sort_array(F.concat(*(_kind_spans(text, kind) for kind in RULES)))


def written(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in RULES))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )), ",")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_new(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> None:
    """Scans the blobs of ``versions`` (blob, text) that the ledger lacks, and adds them.

    The ledger is a folder of Parquet, partitioned by rule version; a write that fails
    commits nothing, so the scan can be repeated.
    """
    spark = versions.sparkSession
    if path_exists(spark, ledger):
        seen = read_ledger(spark, ledger, rule_version).select("blob")
        versions = versions.join(seen, "blob", "left_anti")
    unseen = versions.select("blob", "text").dropDuplicates(["blob"])
    found = unseen.select("blob", spans(F.coalesce("text", F.lit(""))).alias("spans"))
    found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)


def read_ledger(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    return (
        spark.read.schema(f"blob binary, spans {_SPANS}, rule_version string").parquet(ledger)
        .filter(F.col("rule_version") == rule_version).drop("rule_version")
    )


def secret_scan(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with ``found``: the spans of every row's text, through the ledger.

    Without a ledger a new one is begun in the shared folder.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "secret-ledger")
    blob = fresh(docs, "blob")
    addressed = docs.drop("found").withColumn(blob, blob_of(F.col("text")))
    scan_new(addressed.select(F.col(blob).alias("blob"), "text"), ledger, rule_version)
    hits = read_ledger(spark, ledger, rule_version).filter(F.size("spans") > 0)
    hits = hits.select(F.col("blob").alias(blob), F.col("spans").alias("found"))
    joined = addressed.join(hits, blob, "left").drop(blob)
    return joined.withColumn("found", F.coalesce("found", F.array().cast(_SPANS)))


def report(scanned: DataFrame) -> list[Column]:
    """The counted and written columns of a scan's result."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == list(RULES).index(k))).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return [
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
    ]


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    def joined(known: Column) -> Column:
        points, reached = known["points"], known["reached"]

        def piece(start: Column, stop: Column) -> Column:
            return F.decode(F.substring(points, 4 * start + 1, 4 * F.greatest(stop - start, F.lit(0))), "UTF-32")

        # of spans that overlap the first brings the mark, and each what lies between it and all before it
        pieces = F.transform(found, lambda s, i: F.when(i == 0, F.concat(piece(F.lit(0), s["start"]), F.lit(mark))).when(
            s["start"] >= F.get(reached, i - 1), F.concat(piece(F.get(reached, i - 1), s["start"]), F.lit(mark))
        ).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), piece(F.element_at(reached, -1), F.length(text)))

    # four bytes a code point: a piece is found without reading what precedes it
    points = F.encode(text, "UTF-32").alias("points")
    reached = running(F.transform(found, lambda s: s["stop"]), lambda a, x: F.when(a > x, a).otherwise(x)).alias("reached")
    return F.when(F.size(found) > 0, let(F.struct(points, reached), joined)).otherwise(text)


def secret_stage(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; ``n_chars`` follows the text."""
    scanned = secret_scan(docs)
    text = redacted(F.col("text"), F.col("found"))
    out = scanned.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
