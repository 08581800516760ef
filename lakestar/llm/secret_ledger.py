"""Secret scan with an incremental ledger of content-addressed blobs (SQL functions only).

Every historical version of every path is addressed by the SHA-256 of its text.  A ledger
holds, for each (blob, rule, rule version) that was ever scanned, the spans found there.  A
scan reads the text of those blobs only that have an unseen pair, once per blob, and joins
the findings back to all paths that carry the blob.

Spans are code-point offsets (end exclusive) of whole matches.  Within one rule matches are
leftmost and non-overlapping; a match whose measured group is too short is dropped but has
consumed its text.  Their places follow from the lengths of the matches and of the text
between them, so no row leaves the JVM.

Defined cases: null texts count as empty (they have one blob, without findings); repeated
rows and equal texts share a blob and each get its findings; a null path id is carried
through; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestar.llm.common import id_and_text, stored

LEDGER_SCHEMA = ("blob string, rule string, version int, "
                 "spans array<struct<start:int, end:int>>")


@dataclass(frozen=True)
class Rule:
    """A secret kind: a pattern, and the group whose length must reach ``least``."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The three kinds of secret, in the order in which ties are listed.  A run that
# is too short matches nowhere inside itself, so its least length can stand in the pattern.
RULES = (
    Rule("assign", 1, "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token",
                                                     "api_?key")))
         + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of one rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("kept"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + F.coalesce(m["size"], F.lit(0))  # the last gap has no match
        span = F.struct(start.alias("start"), end.alias("end"))
        keep = F.coalesce(m["kept"], F.lit(0)) >= rule.least
        return F.struct(end.alias("at"),
                        F.when(keep, F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    spans = F.aggregate(found, start, step, lambda state: state["spans"])
    # Most texts hold no match at all: one search decides.
    return F.when(F.coalesce(text.rlike(rule.pattern), F.lit(False)), spans).otherwise(empty)


def blobs_of(docs: DataFrame) -> DataFrame:
    """doc_id, blob, text: each version with its content address."""
    return id_and_text(docs).select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")


def unseen_pairs(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blob, carrier (one doc_id that has it), kinds: rules of versions not yet in the ledger."""
    carriers = blobs.groupBy("blob").agg(F.min("doc_id").alias("carrier"))
    wanted = carriers.select("blob", "carrier", F.explode(F.array(*[
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))
        for r in rules])).alias("pair")).select("blob", "carrier", "pair.rule", "pair.version")
    if ledger is None:
        return carriers.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    known = ledger.select("blob", "rule", "version")
    return (wanted.join(known, ["blob", "rule", "version"], "left_anti")
            .groupBy("blob", "carrier").agg(F.collect_set("rule").alias("kinds")))


def ledger_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
                ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: every unseen (blob, rule, version) of ``docs``, scanned once.

    Texts move once, towards the narrow list of blobs to scan; equal blobs are not rescanned.
    """
    versions = blobs_of(docs)
    todo = unseen_pairs(versions.select("doc_id", "blob"), rules, ledger).select(
        F.col("blob").alias("todo"), "carrier", "kinds")
    texts = versions.join(
        todo.hint("shuffle_hash"),
        (F.col("blob") == F.col("todo")) & F.col("doc_id").eqNullSafe(F.col("carrier")))
    found = texts.select("blob", *[
        F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("text"), r)).alias(r.kind)
        for r in rules])
    # A carrier that is itself a repeated row would list its blob twice.
    found = found.groupBy("blob").agg(*[F.max(r.kind).alias(r.kind) for r in rules])
    rows = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                              F.col(r.kind).alias("spans")) for r in rules])
    return (found.select("blob", F.explode(rows).alias("r"))
            .where("r.spans is not null").select("blob", "r.rule", "r.version", "r.spans"))


def update_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
                  ledger: DataFrame | None = None) -> DataFrame:
    """The ledger with all pairs of ``docs`` in it, new rows written to the shared folder."""
    fresh = stored(ledger_rows(docs, rules, ledger), "secret_ledger")
    return fresh if ledger is None else ledger.unionByName(fresh)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (start, kind's place, end, kind; in that order) of the blobs with findings."""
    place = F.lit(-1)
    for i, r in enumerate(rules):
        place = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), i).otherwise(place)
    return (ledger.withColumn("place", place).where("place >= 0 and size(spans) > 0")
            .withColumn("tagged", F.transform("spans", lambda s: F.struct(
                s["start"].alias("start"), F.col("place").alias("place"),
                s["end"].alias("end"), F.col("rule").alias("kind"))))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("tagged"))).alias("spans")))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans for every row of ``docs``: the ledger's findings on all paths."""
    paths = blobs_of(docs).select("doc_id", "blob")
    return (paths.join(blob_findings(ledger, rules), "blob", "left")
            .select("doc_id", F.coalesce("spans", F.expr(
                "cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)"))
                .alias("spans")))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of each kind, the spans as text, and their SHA-256."""
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(r.kind).alias(f"n_{r.kind}") for r in rules]
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"),
                        listed.alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
         ledger: DataFrame | None = None) -> DataFrame:
    """Scan what the ledger has not seen and return the digest of every row."""
    return digest(findings(docs, update_ledger(docs, rules, ledger), rules), rules)


def redacted(docs: DataFrame, ledger: DataFrame, mark: str = "[SECRET]",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the text of every span (overlapping ones together) replaced by ``mark``.

    Keeps all columns; ``n_chars`` is counted anew where the table has it.
    """
    found = blob_findings(ledger, rules)
    rows = docs.select(F.struct("*").alias("row"), F.sha2(
        F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    # Blobs with findings are few and narrow: the hashed side.
    rows = rows.join(found.hint("shuffle_hash"), "blob", "left")
    text = F.col("row.text")

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        part = F.concat(state["out"], before,
                        F.when(s["start"] >= state["at"], mark).otherwise(""))
        return F.when(s["end"] > state["at"], F.struct(
            s["end"].alias("at"), part.alias("out"))).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda state: F.concat(
        state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    rows = rows.select("row", F.when(F.size("spans") > 0, clean).otherwise(text).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of the digest of every row of ``table``."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {i} AS place, '{r.kind}' AS kind,
               s - length(m) AS "start", s AS "end", g FROM (
          SELECT doc_id, m, g, sum(length(p) + coalesce(length(m), 0)) OVER (
                   PARTITION BY doc_id ORDER BY i) AS s
          FROM (SELECT doc_id, unnest(ps) AS p, unnest(ms) AS m, unnest(gs) AS g,
                       unnest(range(len(ps))) AS i
                FROM (SELECT doc_id, string_split_regex(t, '{p}') AS ps,
                             regexp_extract_all(t, '{p}') AS ms,
                             regexp_extract_all(t, '{p}', {r.group}) AS gs FROM d)))
        WHERE m IS NOT NULL AND length(g) >= {r.least}""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
    found AS ({union}),
    listed AS (
      SELECT d.doc_id, {counts},
             coalesce(string_agg(kind || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ','
                                 ORDER BY "start", place), '') AS spans
      FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id)
    SELECT doc_id, {", ".join(f"n_{r.kind}" for r in RULES)}, sha256(spans) AS base_sha256, spans
    FROM listed"""
