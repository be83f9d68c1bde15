"""Pattern detection: files x rules, first unsuppressed match and match count per file and rule.

Two steps inside one stage, without a shuffle:

1. One projection tests every rule on every file. A rule is a literal expression: file type, then
   literal gates over the lower-cased text; the first that fails ends the test. Rules that may match
   a file come out as rows; a rule without a gate is tried.
2. Only those are joined to the broadcast catalog, and their regular expression runs over the text
   once, which finds, locates and counts the matches inside the row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.catalog.rules import ENTROPY_RULE, Rule, select_rules
from auditlake.config import CUSTOM_ORD, ScanConfig, custom_rule, jvm_pattern
from auditlake.functions import text as tx
from auditlake.functions.dialect import to_jvm
from auditlake.functions.literals import LEAST_BITS, START_BITS, WIDTHS, BlockFilter, Patterns, filter_bits, literal_places, required_literals, width_of
from auditlake.functions.scoring import rank_of
from auditlake.operators import entropy
from auditlake.operators.findings import finding_row, jvm_catalog, rule_catalog, union_findings
from auditlake.operators.durable import durable, staged
from auditlake.operators.joins import BROADCAST_BYTES, join_bounded, skewed_join

MATCH = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("n", T.LongType())])
#: Custom patterns beyond which an automaton over texts they require says which are tried on a file.
MANY = 64
#: Projects whose automata a task keeps.
PROJECTS_BUILT = 64
#: Patterns that are compiled together, patterns of one automaton, and bytes of the files it runs over.
PIECE, BLOCK, PART_BYTES = 1000, 100_000, 32 << 20


def applies(rule: Rule) -> str:
    """File type predicate of a rule over the ``ext`` column."""
    return f"ext IN ({', '.join(map(tx.sql_literal, rule.extensions))})" if rule.extensions else "true"


def gate_tests(rule: Rule) -> list[str]:
    """Tests that a rule's matches pass, cheapest first, over the columns ext and lowered.

    SQL text rather than Column calls: a catalog-wide projection holds some thousand nodes, and
    building each through the gateway would cost more than scanning a small corpus.
    """
    tests = [applies(rule)] if rule.extensions else []
    tests += [f"contains(lowered, {tx.sql_literal(text)})" for text in rule.need]
    if rule.gate:
        tests.append("(" + " OR ".join(f"contains(lowered, {tx.sql_literal(text)})" for text in rule.gate) + ")")
    if rule.near:
        tests.append(f"rlike(lowered, {tx.sql_literal(to_jvm(rule.near, flags='(?d)'))})")
    return tests


def rule_test(rule: Rule) -> str:
    """Whether a rule matches, over the columns ext, lowered and content."""
    return " AND ".join([*gate_tests(rule), f"rlike(content, {tx.sql_literal(to_jvm(rule.scanned[0]))})"])


def may_match(rule: Rule) -> str:
    """Whether a rule can match: what its gates say, so that its pattern runs over a text once. Without a gate the pattern says."""
    return " AND ".join(gate_tests(rule)) if rule.gate or rule.need or rule.near else rule_test(rule)


def with_ext(files: DataFrame) -> DataFrame:
    return files if "ext" in files.columns else files.withColumn("ext", tx.file_ext(F.col("path")))


def find_hits(files: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(project, path, content, kept columns, rule_ord) for every file and rule that may match."""
    base = with_ext(files).select(
        "project", "path", "content", *keep, "ext", tx.gate_text(F.col("content")).alias("lowered")
    )
    tests = ", ".join(f"CASE WHEN {may_match(r)} THEN {r.rule_ord} END" for r in rules)
    return base.select(
        "project", "path", "content", *keep, F.expr(f"explode(array_compact(array({tests})))").alias("rule_ord")
    )


def first_and_count(marker: str) -> Column:
    """Array of one (line, raw, n, value): a hit's earliest unsuppressed line and number of unsuppressed matches."""
    return F.expr(f"""
        array(aggregate(
          matches,
          named_struct('line', int(null), 'raw', string(null), 'n', bigint(0), 'value', string(null)),
          (acc, x) -> CASE WHEN {tx.suppressed_sql('x.raw', 'rule_id', marker)} THEN acc
            ELSE named_struct('line', coalesce(acc.line, x.line), 'raw', coalesce(acc.raw, x.raw),
                              'n', acc.n + x.n, 'value', acc.value) END))""")


def _to_findings(located: DataFrame, rows: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with catalog columns, and per hit an array of (line, raw, n, value) -> findings."""
    kept = [c for c in located.columns if c not in ("matches", "values")]
    bits = F.format_string(" (entropy=%.2f bits/char)", tx.shannon_entropy("value"))
    described = tx.describe_count(F.col("description"), F.col("n"))
    description = F.when(F.col("value").isNotNull(), F.concat(F.col("description"), bits)).otherwise(described)
    return (
        located.select(*kept, F.inline(rows))
        .filter(F.col("n") > 0)
        .select(*finding_row(line=F.col("line"), raw=F.col("raw"), count=F.col("n"), description=description), *keep)
    )


def detect_rules(
    files: DataFrame, rules: Iterable[Rule], marker: str = tx.DEFAULT_MARKER, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Findings of the given rules: one row per file and rule; the entropy rule may give several.

    ``keep`` names columns of the files that the findings carry along, such as an event time.
    """
    rules = tuple(rules)
    native = tuple(r for r in rules if jvm_pattern(r.pattern) is not None)
    other = tuple(r for r in rules if jvm_pattern(r.pattern) is None)
    parts = []
    if native or not other:
        parts.append(_by_spark(files, native, marker, keep))
    if other:
        located = _by_python(files, other, keep)
        parts.append(_to_findings(located, first_and_count(marker), keep))
    return union_findings(*parts)


def _by_spark(files: DataFrame, rules: tuple[Rule, ...], marker: str, keep: tuple[str, ...]) -> DataFrame:
    hits = find_hits(files, rules, keep) if rules else _no_hits(files, keep)
    located = (
        hits.join(F.broadcast(jvm_catalog(files.sparkSession, rules)), "rule_ord")
        .withColumn("mark", tx.sentinel(F.col("content")))
        .withColumn("matches", tx.match_lines(grouped="grouped"))
        .drop("grouped")
    )
    first = first_and_count(marker)
    if ENTROPY_RULE not in rules:
        return _to_findings(located.drop("content", "pattern", "mark"), first, keep)
    # values first, as a column of their own: the step that picks one per line reads them repeatedly
    located = located.withColumn("values", entropy.qualified(marker)).drop("content", "pattern", "mark")
    rows = F.when(F.col("rule_ord") == ENTROPY_RULE.rule_ord, entropy.first_per_line()).otherwise(first)
    return _to_findings(located, rows, keep)


def _no_hits(files: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return files.select("project", "path", "content", *keep, F.lit(None).cast("int").alias("rule_ord")).filter(F.lit(False))


def _by_python(files: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...]) -> DataFrame:
    """Matches found by Python's own engine. Each file is sent to Python once, with all its patterns."""
    base = with_ext(files).select("project", "path", "content", "ext", *keep)
    sources, types = [r.pattern for r in rules], [set(r.extensions) if r.extensions else None for r in rules]
    ords = [r.rule_ord for r in rules]
    schema = T.StructType([*(base.schema[c] for c in ("project", "path", *keep)), T.StructField("rule_ord", T.IntegerType()), T.StructField("matches", T.ArrayType(MATCH))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = Patterns(sources)
        for batch in batches:
            rows = []
            for project, path, content, ext, *kept in batch.itertuples(index=False, name=None):
                for k, found in patterns.matches(content, types, ext) if isinstance(content, str) else ():
                    rows.append((project, path, *kept, ords[k], [dict(zip(("line", "raw", "n"), f, strict=True)) for f in found]))
            yield pd.DataFrame(rows, columns=schema.names)

    catalog = F.broadcast(rule_catalog(files.sparkSession, rules))
    return base.mapInPandas(work, schema).join(catalog, "rule_ord").drop("pattern")


def detect(files: DataFrame, config: ScanConfig | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of every selected catalog rule, the entropy rule and the custom patterns, in one pass."""
    config = config or ScanConfig()
    rules, custom = select_rules(config.checks, config.exclude_rules), ()
    if not config.checks or "secrets" in config.checks:
        custom = tuple(r for r in config.custom_rules() if r.rule_id not in config.exclude_rules)
        rules += tuple(r for r in (ENTROPY_RULE,) if r.rule_id not in config.exclude_rules)
    if len(custom) <= MANY:
        return detect_rules(files, rules + custom, config.marker, keep)
    many = _to_findings(_by_python(files, custom, keep), first_and_count(config.marker), keep)
    return union_findings(detect_rules(files, rules, config.marker, keep), many)


def detect_family(files: DataFrame, family: str, marker: str = tx.DEFAULT_MARKER) -> DataFrame:
    """Findings of one rule family (``sql``, ``xss``, ``jwt`` ...)."""
    rules = tuple(r for r in select_rules() if r.family == family)
    if not rules:
        raise ValueError(f"unknown rule family {family!r}")
    return detect_rules(files, rules, marker)


def detect_entropy(files: DataFrame, marker: str = tx.DEFAULT_MARKER) -> DataFrame:
    """High-entropy values assigned to secret names: one finding per file and distinct line."""
    return detect_rules(files, (ENTROPY_RULE,), marker)


def detect_project_patterns(
    files: DataFrame, patterns: DataFrame, marker: str = tx.DEFAULT_MARKER, compat: bool = False
) -> DataFrame:
    """Findings of patterns that differ by project: ``patterns`` is (project, custom_patterns array).

    A project's patterns are broadcast in pieces, so no file moves, and only hits become rows. Where
    a project has more than ``MANY``, Python tries those that an automaton lets through; otherwise the
    JVM tries each, and Python those that have no JVM form. Patterns too large to send are dealt to
    tasks in blocks, each with a part of the project's files.
    """
    rules = durable(compiled_pieces(patterns, compat))
    sent = F.transform("rules", lambda r: r.dropFields("needs"))
    untried = F.max(F.exists("rules", lambda r: r["by_python"].isNull()))
    each = rules.groupBy("project").agg(F.sum(F.size("rules")).alias("n"), F.sum(F.octet_length(F.to_json(sent))).alias("size"), untried.alias("untried"))
    most, size, untried = each.agg(F.max("n"), F.sum("size"), F.max("untried")).first()
    if untried and (size or 0) <= BROADCAST_BYTES and (most or 0) <= MANY:  # fewer are good than there are
        rules = durable(compiled_pieces(patterns, compat, native=True))
    columns = files.select("project", "path", "content")
    if (size or 0) > BROADCAST_BYTES:
        hits = match_pattern_blocks(columns, rules)
    elif (most or 0) > MANY:
        hits = match_project_patterns(columns, rules.collect())
    else:
        only = rules.where("exists(rules, r -> r.by_python)").withColumn("rules", F.filter("rules", lambda r: r["by_python"]))
        hits = jvm_project_matches(columns.join(F.broadcast(rules), "project"))
        rest = only.collect()
        hits = hits.unionByName(match_project_patterns(columns, rest)) if rest else hits
    described = hits.select(
        "*", F.lit("Secrets").alias("category"), rank_of(F.col("severity")).alias("severity_rank"),
        F.lit(0).alias("check_ord"), (F.col("i") + CUSTOM_ORD).alias("rule_ord"), F.lit("HIGH").alias("confidence"),
        *[F.lit("").alias(c) for c in ("cwe_id", "cwe_name", "owasp", "fix_hint")],
    )
    return _to_findings(described, first_and_count(marker))


RULE_FIELDS = ("i", "rule_id", "severity", "description", "remediation")
MATCH_ROW = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("path", T.StringType()), T.StructField("i", T.IntegerType()),
    *(T.StructField(c, T.StringType()) for c in RULE_FIELDS[1:]), T.StructField("matches", T.ArrayType(MATCH)),
])


def jvm_project_matches(base: DataFrame) -> DataFrame:
    """Matches of the patterns with a JVM form, over files that carry their project's rules."""
    hits = base.select("project", "path", "content", F.inline(F.expr("filter(rules, r -> NOT r.by_python AND rlike(content, r.pattern))")))
    located = hits.withColumn("mark", tx.sentinel(F.col("content"))).withColumn("matches", tx.match_lines())
    return located.select("project", "path", *RULE_FIELDS, "matches")




def _match_rows(project: str, path: str, content: str | None, mine: list[tuple], patterns: Patterns) -> Iterator[tuple]:
    """Rows of the patterns that match a file; ``mine`` are the patterns' (source, *RULE_FIELDS)."""
    for k, found in patterns.matches(content) if isinstance(content, str) else ():
        yield project, path, *mine[k][1:], [dict(zip(("line", "raw", "n"), f, strict=True)) for f in found]


def match_project_patterns(files: DataFrame, rules: list) -> DataFrame:
    """Matches of the rules of each file's project, found by Python's engine.

    ``rules`` are rows of ``compiled_pieces``, known to be small, that every task gets. A task builds a
    project's automaton when it meets its first file. Of a project with several rows the last counts.
    """
    fields = ("needs", "source", *RULE_FIELDS)
    own: dict[str, dict[int, list[tuple]]] = {}
    for r in rules:
        own.setdefault(r["project"], {}).setdefault(r["row"], []).extend(tuple(x[f] for f in fields) for x in r["rules"])
    known = files.sparkSession.sparkContext.broadcast({project: rows[max(rows)] for project, rows in own.items()})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, tuple[list, Patterns]] = {}
        for batch in batches:
            rows = []
            for project, path, content in batch.itertuples(index=False, name=None):
                if project not in built:
                    mine = known.value.get(project, [])
                    if len(built) >= PROJECTS_BUILT:
                        built.clear()
                    built[project] = [r[1:] for r in mine], Patterns([r[1] for r in mine], [r[0] for r in mine])
                rows += _match_rows(project, path, content, *built[project])
            yield pd.DataFrame(rows, columns=MATCH_ROW.names)

    return files.mapInPandas(work, MATCH_ROW)


def match_pattern_blocks(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of pieces of patterns (``compiled_pieces``) that are too large to send to every task.

    A file goes to the blocks of ``BLOCK`` patterns of its project that may match it (``may_match_blocks``).
    The files of a block are dealt to parts of ``PART_BYTES``; a task builds the automaton of the block
    for one part and holds no more than the two, however many files and patterns a project has.
    """
    numbered = rules.select("project", F.inline("rules")).withColumn("block", F.floor(F.col("i") / BLOCK))
    kept = staged(may_match_blocks(files, numbered), "matched").withColumn("block", F.explode("blocks")).drop("blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    parts = F.ceil(F.sum(F.octet_length("content")) / F.lit(PART_BYTES)).alias("parts")
    many = durable(kept.groupBy("project", "block").agg(parts).withColumn("parts", F.greatest("parts", F.lit(1))))
    own = join_bounded(kept, many, ["project", "block"], "inner")
    dealt = own.withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts"))).drop("parts")
    sent = skewed_join(numbered, many, ["project", "block"], "inner").select(
        "project", upto(F.col("parts") - 1).alias("part"), "block", "needs", "source", *RULE_FIELDS
    )

    def work(contents: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        mine = list(own[["source", *RULE_FIELDS]].itertuples(index=False, name=None)) if len(contents) else []
        patterns = Patterns([r[0] for r in mine], own["needs"].tolist() if mine else [])
        rows = []
        for row in contents[["project", "path", "content"]].itertuples(index=False, name=None):
            rows += _match_rows(*row, mine, patterns)
        return pd.DataFrame(rows, columns=MATCH_ROW.names)

    keys = ("project", "part", "block")
    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(work, MATCH_ROW)


def may_match_blocks(files: DataFrame, numbered: DataFrame) -> DataFrame:
    """Files (project, path, content) with the blocks of ``numbered`` patterns that may match them, if there are such.

    Stretches of the texts that patterns require are put into a filter of 66 MiB at most, which is
    sent to every task; more of them than fit make it less selective. Blocks with patterns that require
    no text take every file of their project.
    """
    spark, salt = files.sparkSession, F.xxhash64("project")
    words = numbered.select(salt.alias("salt"), "block", F.explode("needs").alias("word"))
    count, widths = words.agg(F.count("*"), F.collect_set(F.least(F.length("word"), F.lit(WIDTHS[-1])))).first()
    bits, piece = filter_bits(count), LEAST_BITS
    pieces = ((1 << bits) + (1 << START_BITS)) >> piece

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, blocks = (batch.column(c).to_numpy().view(np.uint64) for c in ("salt", "block"))
            places = np.unique(literal_places(batch.column("word").to_pylist(), salts, blocks, bits))
            ends = np.searchsorted(places >> np.uint64(piece), np.arange(pieces + 1))
            rows = [(k, (places[i:j] & np.uint64((1 << piece) - 1)).astype(np.uint32).tobytes()) for k, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
            yield pa.RecordBatch.from_pydict({"piece": [k for k, _ in rows], "bits": [x for _, x in rows]}, schema=pa.schema([("piece", pa.int32()), ("bits", pa.binary())]))

    def united(group: pa.Table) -> pa.Table:
        table = np.zeros(1 << piece, np.uint8)
        for x in group.column("bits").to_pylist():
            table[np.frombuffer(x, np.uint32)] = 1
        return pa.table({"piece": group.column("piece")[:1], "bits": [np.packbits(table, bitorder="little").tobytes()]}, schema=group.schema)

    layout = "piece int, bits binary"
    found = {r["piece"]: r["bits"] for r in words.mapInArrow(set_bits, layout).groupBy("piece").applyInArrow(united, layout).collect()}
    empty = bytes(1 << (piece - 3))
    table = np.frombuffer(b"".join(found.get(k, empty) for k in range(pieces)), np.uint8)
    known = spark.sparkContext.broadcast((table, bits, sorted({width_of(n) for n in widths})))
    always = F.sort_array(F.collect_set(F.when(F.col("needs").isNull(), F.col("block")))).alias("always")
    each = numbered.groupBy("project").agg(F.max("block").alias("last"), always)
    columns = T.StructType([*(files.schema[c] for c in ("project", "path", "content")), T.StructField("blocks", T.ArrayType(T.LongType()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = BlockFilter(*known.value)
        for batch in batches:
            batch = batch.filter(batch.column("content").is_valid())
            if batch.num_rows:
                salts = batch.column("salt").to_numpy().view(np.uint64)
                some = filter_.blocks(batch.column("content").to_pylist(), salts, batch.column("last").to_numpy())
                blocks = [sorted(x.union(y)) for x, y in zip(some, batch.column("always").to_pylist(), strict=True)]
                keep = pa.array([k for k, x in enumerate(blocks) if x], pa.int64())
                own = [batch.column(c).take(keep) for c in ("project", "path", "content")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([x for x in blocks if x], pa.list_(pa.int64()))], names=columns.names)

    own = join_bounded(files, each, ["project"], "inner").withColumn("salt", salt)
    return own.mapInArrow(look, columns)


def compiled_pieces(patterns: DataFrame, compat: bool = False, native: bool | None = None) -> DataFrame:
    """(project, row, rules) of (project, custom_patterns): pieces of a row's patterns, compiled by several tasks and numbered through the row.

    JVM forms are only made if no project has more than ``MANY`` patterns, or if ``native`` says so.
    """
    starts = F.expr(f"explode(transform(sequence(1, size(custom_patterns), {PIECE}), at -> struct(at AS at, slice(custom_patterns, at, {PIECE}) AS own)))")
    numbered = durable(patterns.where("size(custom_patterns) > 0").select("project", "custom_patterns", F.monotonically_increasing_id().alias("row")))
    if native is None:
        native = (numbered.groupBy("project").agg(F.sum(F.size("custom_patterns")).alias("n")).agg(F.max("n")).first()[0] or 0) <= MANY
    pieces = numbered.select("project", "row", starts.alias("piece")).select("project", "row", "piece.*").repartition(3 * patterns.sparkSession.sparkContext.defaultParallelism, "row", "at")
    # written before it is filtered: the filter would go below the shuffle and compile all once more, in one task for each row
    compiled = durable(pieces.select("project", "row", "at", compile_patterns(compat, native)(F.col("own")).alias("rules"))).where("size(rules) > 0")
    before = F.sum("n").over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = compiled.select("row", "at", F.size("rules").alias("n")).select("row", "at", F.coalesce(before, F.lit(0)).cast("int").alias("before"))
    return compiled.join(placed, ["row", "at"]).select("project", "row", F.transform("rules", lambda r: r.withField("i", r["i"] + F.col("before"))).alias("rules"))


def compile_patterns(compat: bool = False, native: bool = True):
    """Settings' custom patterns with defaults filled in, and patterns in JVM syntax if ``native``; bad ones are dropped."""

    @F.pandas_udf(
        "array<struct<i:int,rule_id:string,pattern:string,source:string,severity:string,description:string,remediation:string,"
        "by_python:boolean,needs:array<string>>>"
    )
    def compile_all(custom: pd.Series) -> pd.Series:
        def one(entries):
            out = []
            for entry in entries if entries is not None else []:
                try:
                    rule = custom_rule(entry, compat=compat)
                except (ValueError, TypeError, AttributeError):
                    continue
                form, needs = jvm_pattern(rule.pattern) if native else None, required_literals(rule.pattern)
                out.append({
                    "i": len(out), "rule_id": rule.rule_id, "pattern": form or rule.pattern, "source": rule.pattern, "severity": rule.severity,
                    "description": rule.description, "remediation": rule.remediation, "by_python": form is None if native else None,
                    "needs": None if needs is None else sorted(needs),
                })
            return out

        return custom.map(one)

    return compile_all
