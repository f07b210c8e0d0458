"""Secret scans over an incremental ledger of content-addressed blobs."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored

from .shared import bit_words, may_contain, membership_bits, spare_names, text_or_empty, without

LEDGER_SCHEMA = "blob binary, rules array<string>, findings array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``value_group`` must have ``least`` characters; ``hint`` is a text without which nothing can match."""

    kind: str
    pattern: str
    version: int = 1
    value_group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value_group=2,
        least=6,
    ),
    # A run that is too short fails as a whole, so the least length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", hint="eyJ"),
)
ALL_RULES = (*BASE_RULES, *MORE_RULES)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost, non-overlapping matches as (start, rank, kind, end); code points, end exclusive.

    The pieces between matches give the places, as Spark's functions return the matched texts alone.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.value_group))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(state: Column, match: Column) -> Column:
        start = state["at"] + F.length(match["gap"])
        end = start + F.length(match["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        held = F.when(F.length(match["value"]) >= rule.least, F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), F.coalesce(held, state["spans"]).alias("spans"))

    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    found = F.aggregate(matches, begin, step, lambda state: state["spans"])
    present = F.contains(text, F.lit(rule.hint)) & F.rlike(text, pattern) if rule.hint else F.rlike(text, pattern)
    return F.when(present, found).otherwise(none)


def _scan(text: Column, rules: Sequence[Rule], wanted: Column) -> Column:
    """Matches of those rules whose keys are in ``wanted``."""
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = [F.when(F.array_contains(wanted, r.key), rule_spans(text, r, rank)).otherwise(none) for rank, r in enumerate(rules)]
    return F.array_sort(F.concat(*parts))


def _unseen_rules(counted: DataFrame, ledger: DataFrame | None, keys: list[str]) -> DataFrame:
    """``counted`` with ``missing``, the rules by which the ledger has not scanned the blob, in their order."""
    every = F.array(*map(F.lit, keys)).cast("array<string>")
    if ledger is None:
        return counted.withColumn("missing", every)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    left = F.coalesce(F.array_except(every, F.col("seen")), every)
    return counted.join(seen, "blob", "left").select(*counted.columns, left.alias("missing"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = ALL_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows: one per blob (SHA-256 of a text) that was not scanned by all ``rules``, with those it lacked.

    A narrow join of blobs and ledger says what each blob lacks, and most blobs lack the same: everything in
    a first scan, the new rules after a change of rules, nothing on a later day. What most lack is scanned
    where texts are read, or nowhere if it is nothing. The exceptions (blobs that lack something else, and
    repeated ones) pass a Bloom filter and a join on (blob, id) of one carrier per blob, so only the carriers'
    texts move; a carrier is one row however many copies the blob has.

    A null text counts as empty, and null ids carry as well as others; of rows that repeat an id and its text
    one is scanned. Texts are read whole. An empty table, or one that is known, gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("blob", F.unhex(F.sha2("text", 256)))
    keys = [rule.key for rule in rules]
    counted = docs.groupBy("blob").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id"))
    blobs = stored(_unseen_rules(counted, ledger, keys))
    # One row for each set of missing rules, of which the first alone comes here.
    usual = blobs.groupBy("missing").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "missing").first()
    usual = list(usual["missing"]) if usual else []

    other = F.col("missing") != F.array(*map(F.lit, usual)).cast("array<string>")
    exceptions = blobs.filter(other | (F.col("rows") > 1) if usual else other).select("blob")
    exceptional = may_contain(membership_bits(exceptions, bit_words(exceptions.count())), F.col("blob"))

    todo = blobs.filter(exceptional & (F.size("missing") > 0)).select("blob", "id", "missing")
    same = F.col("d.blob").eqNullSafe(F.col("t.blob")) & F.col("d.id").eqNullSafe(F.col("t.id"))
    carriers = docs.filter(exceptional).alias("d").join(todo.alias("t"), same).select("d.blob", "d.text", "t.missing")
    scanned = carriers.select("blob", F.col("missing").alias("rules"), _scan(F.col("text"), rules, F.col("missing")).alias("findings"))
    # One id may stand in several rows with the same text; their findings are the same.
    scanned = scanned.dropDuplicates(["blob"])
    if not usual:
        return scanned
    wanted = F.array(*map(F.lit, usual))
    here = [rule_spans(F.col("text"), rule, rank) for rank, rule in enumerate(rules) if rule.key in usual]
    return docs.filter(~exceptional).select("blob", wanted.alias("rules"), F.array_sort(F.concat(*here)).alias("findings")).unionByName(scanned)


def findings_by_path(docs: DataFrame, ledger: DataFrame, text_col: str = "text", rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Every row of ``docs`` with ``findings``, taken from the current rule versions in the ledger.

    Rows of one blob found in several scans are put together. Only blobs with findings are joined; a
    blob that a third of all rows share is split by adaptive execution.
    """
    docs = without(docs, ["findings"])
    (blob,) = spare_names(docs, "blob")
    current = [r.key for r in rules]
    kinds = {r.kind: rank for rank, r in enumerate(rules)}
    spans = ledger.filter(F.size("findings") > 0).select("blob", F.explode("findings").alias("f"), "rules")
    rank_of = F.create_map(*[F.lit(x) for kind, rank in kinds.items() for x in (kind, rank)])
    live = F.arrays_overlap("rules", F.array(*[F.lit(k) for k in current])) & F.exists(
        F.array(*[F.lit(k) for k in current]), lambda k: F.array_contains("rules", k) & (F.substring_index(k, "@", 1) == F.col("f.kind"))
    )
    spans = spans.filter(live).select("blob", F.struct("f.start", F.element_at(rank_of, F.col("f.kind")).alias("rank"), "f.kind", "f.end").alias("f"))
    found = spans.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings")).withColumnRenamed("blob", blob)
    found = stored(found)  # a table of its own, so that the join can split a hot blob
    keyed = docs.withColumn(blob, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return keyed.join(found, blob, "left").select(*docs.columns, F.coalesce("findings", empty).alias("findings"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda f: f["kind"] == kind)).cast("long")
