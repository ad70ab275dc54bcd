"""Ledger entries: which drafts and commands are valid, which case they join, and what the ledger's pages show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.sequences import running_rank

#: Kinds of entries by their role.
OPERATOR_KINDS = ("operator_note", "intervention", "review", "amendment", "redaction")
CASE_KINDS = ("intent", "order", "fill", "position", "exit")
FAMILIES = {
    "decisions": ("decision", "risk"),
    "orders": ("intent", "order"),
    "fills": ("fill",),
    "positions": ("position", "exit"),
    "reconciliation": ("reconciliation",),
    "incidents": ("incident", "operator_note"),
}
ROWS, INCIDENTS, DECISIONS = 256, 8, 3


def _first_problem(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules])


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("0")).isin("0", "")


def _bad_range() -> Column:
    given = F.col("first_sequence").isNotNull() | F.col("last_sequence").isNotNull()
    return given & ((F.coalesce("first_sequence", F.lit(0)) == 0) | ~F.coalesce(F.col("last_sequence") >= F.col("first_sequence"), F.lit(False)))


def draft_problems(drafts: DataFrame, ledger: DataFrame) -> DataFrame:
    """``drafts`` with ``problem``, the first rule that each breaks.

    drafts: entry_id, source_key, actor_id, actor_kind, schema_version, kind,
    case_id, parent_id (0: none), event_ns, received_ns, recorded_ns,
    first_sequence, last_sequence, body.  ledger: entry_id, case_id.
    """
    parents = ledger.select(F.col("entry_id").alias("__parent"), F.col("case_id").alias("__parent_case"))
    seen = drafts.join(parents, F.col("parent_id") == F.col("__parent"), "left")
    operator = F.col("kind").isin(*OPERATOR_KINDS)
    has_parent = ~_missing("parent_id")
    problem = _first_problem(
        (_missing("source_key"), "missing source key"),
        (_missing("actor_id") | (F.coalesce("schema_version", F.lit(0)) == 0), "missing identity"),
        ((F.col("received_ns") < F.col("event_ns")) | (F.col("recorded_ns") < F.col("received_ns")), "time order"),
        (_bad_range(), "canonical range"),
        (operator & (F.col("actor_kind") != "operator"), "actor kind"),
        (operator & (F.coalesce("body", F.lit("")) == ""), "missing body"),
        (F.col("kind").isin("amendment", "redaction") & ~has_parent, "missing parent"),
        (has_parent & F.col("__parent").isNull(), "unknown parent"),
        (has_parent & (F.col("__parent_case") != F.col("case_id")), "parent of another case"),
    )
    return seen.withColumn("problem", problem).drop("__parent", "__parent_case")


def automatic_problems(commands: DataFrame) -> DataFrame:
    """``commands`` with ``problem``: source_key, actor_id, actor_kind, kind, policy (none, existing, correlate), case_id, correlation, event_ns, received_ns, schema_version, first_sequence, last_sequence, body."""
    problem = _first_problem(
        (_missing("source_key"), "missing source key"),
        (_missing("actor_id"), "missing actor"),
        ((F.col("actor_kind") == "operator") | F.col("kind").isin(*OPERATOR_KINDS), "operator authority"),
        (F.coalesce("body", F.lit("")) == "", "missing body"),
        (F.col("received_ns") < F.col("event_ns"), "time order"),
        (F.coalesce("schema_version", F.lit(0)) == 0, "missing schema version"),
        (_bad_range(), "canonical range"),
        ((F.col("policy") == "none") & F.col("kind").isin(*CASE_KINDS), "case required"),
        ((F.col("policy") == "existing") & _missing("case_id"), "missing case"),
        ((F.col("policy") == "correlate") & _missing("correlation"), "missing correlation"),
    )
    return commands.withColumn("problem", problem)


def operator_problems(commands: DataFrame, ledger: DataFrame) -> DataFrame:
    """``commands`` with ``problem``: command_key, body, submitted_ns, kind, mutation (append, amend, redact), case_id, parent_id.  ledger: entry_id, actor_kind."""
    parents = ledger.select(F.col("entry_id").alias("__parent"), F.col("actor_kind").alias("__parent_actor"))
    seen = commands.join(parents, F.col("parent_id") == F.col("__parent"), "left")
    has_parent = ~_missing("parent_id")
    problem = _first_problem(
        (_missing("command_key"), "missing key"),
        (F.trim(F.coalesce("body", F.lit(""))) == "", "missing body"),
        (F.col("submitted_ns") < 0, "time"),
        (F.col("kind").isin("intervention", "review") & _missing("case_id"), "case required"),
        ((F.col("mutation") != "append") & (_missing("case_id") | ~has_parent), "case and parent required"),
        (has_parent & F.col("__parent").isNull(), "unknown parent"),
        (has_parent & (F.col("__parent_actor") != "operator"), "machine evidence"),
    )
    return seen.withColumn("problem", problem).drop("__parent", "__parent_actor")


def assign_cases(commands: DataFrame, known: DataFrame, next_case: int, *, cell: str) -> DataFrame:
    """``commands`` with the case each joins, and whether it conflicts with the case its correlation has.

    commands: ordinal, policy, case_id, correlation; known: correlation, case_id of
    the ledger.  Without a policy an entry has case 0; an existing case is taken,
    unless its correlation has another one; a correlated entry takes the case of
    its correlation: that of the ledger, else that of the first command which
    names it, a new case's number counting up from ``next_case`` in order of
    first appearance.  cell: a column that never falls along the ordinal.
    """
    named = commands.where((F.col("policy") != "none") & ~_missing("correlation"))
    asks = F.struct("ordinal", "policy", "case_id", cell)
    first = named.groupBy("correlation").agg(F.min(asks).alias("first")).join(known.withColumnRenamed("case_id", "__known"), "correlation", "left")
    new = first.where(F.col("__known").isNull() & (F.col("first.policy") == "correlate")).select("correlation", F.col("first.ordinal").alias("ordinal"), F.col(f"first.{cell}").alias("cell"))
    numbered = running_rank(new, cell="cell", order=["ordinal"], into="n").select("correlation", (F.col("n") + next_case - 1).alias("__new"))
    cases = first.join(numbered, "correlation", "left").select(F.col("correlation").alias("__correlation"), F.coalesce("__known", "__new", F.col("first.case_id")).alias("__case"))
    out = commands.join(cases, F.col("correlation") == F.col("__correlation"), "left")
    conflict = (F.col("policy") == "existing") & F.col("__case").isNotNull() & (F.col("__case") != F.col("case_id"))
    case = F.when(F.col("policy") == "none", F.lit(0)).when(F.col("policy") == "existing", F.col("case_id")).otherwise(F.col("__case"))
    return out.withColumn("assigned", F.when(~F.coalesce(conflict, F.lit(False)), case).cast("long")).withColumn("conflict", F.coalesce(conflict, F.lit(False))).drop("__correlation", "__case")


def with_bodies(headers: DataFrame, bodies: DataFrame) -> DataFrame:
    """``headers`` with the body each refers to and ``problem``: a body is found by its number, and must have the length and digest of the header.

    headers: entry_id, body_id, body_len, body_digest; bodies: body_id, body.
    """
    cold = bodies.select(F.col("body_id").alias("__body_id"), "body", F.octet_length("body").alias("__len"), F.md5("body").alias("__digest"))
    met = headers.join(cold, F.col("body_id") == F.col("__body_id"), "left")
    problem = _first_problem((F.col("__body_id").isNull(), "no body"), (F.col("body_len") != F.col("__len"), "length"), (F.col("body_digest") != F.col("__digest"), "digest"))
    return met.withColumn("problem", problem).withColumn("body", F.when(F.col("problem").isNull(), F.col("body"))).drop("__body_id", "__len", "__digest")


def by_family(entries: DataFrame) -> DataFrame:
    """Each entry once for the lifecycle page and once for each page that shows its kind: view, and the entry's columns."""
    views = [F.when(F.col("kind").isin(*kinds), F.lit(name)) for name, kinds in FAMILIES.items()]
    return entries.select(F.explode(F.array_compact(F.array(F.lit("lifecycle"), *views))).alias("view"), "*")


def visible(entries: DataFrame, n: int = ROWS) -> DataFrame:
    """The newest ``n`` entries, which pages show."""
    return entries.orderBy(F.desc("entry_id")).limit(n)


def incidents(entries: DataFrame, n: int = INCIDENTS) -> DataFrame:
    """The newest ``n`` incidents among the visible entries, by kind or by status."""
    return visible(entries).where((F.col("kind") == "incident") | (F.col("status") == "incident")).orderBy(F.desc("entry_id")).limit(n)


def top_decisions(entries: DataFrame, n: int = DECISIONS) -> DataFrame:
    """The newest ``n`` decisions among the visible entries."""
    return visible(entries).where(F.col("kind").isin(*FAMILIES["decisions"])).orderBy(F.desc("entry_id")).limit(n)
