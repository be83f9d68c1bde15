"""Source files, manifests and commit logs derived from the given tables.

The given text holds no code. Each document becomes a file: its whole text followed by one block of
code lines picked by its id. Everything grows with the tables. The same derivation is written
twice, as DataFrames here and as SQL text for the result check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.catalog.rules import ENTROPY_RULE_ID, FAMILIES
from auditlake.functions.text import DEFAULT_MARKER
from workload.spread import spread
from workload.samples import POSITIVE, RANDOM32

EXTENSIONS = (".py", ".js", ".json", ".yaml", ".env")
PROJECTS = 9


def _block(family) -> str:
    """One line per rule, then a repeated line, a line suppressed for its rule and one not covered."""
    lines = [POSITIVE[r.rule_id] for r in family.rules]
    first = family.rules[0].rule_id
    sample = POSITIVE[first]
    lines.append("plain line")
    lines.append(f"    {sample}")
    lines.append(f"{sample} # {DEFAULT_MARKER} {first}")
    lines.append(f"{sample} // {DEFAULT_MARKER} OTHER-1 note")
    last = POSITIVE[family.rules[-1].rule_id].split("\n")
    lines.append(f"{last[0]} // {DEFAULT_MARKER}")
    if family.name == "secrets":
        lines += [POSITIVE[ENTROPY_RULE_ID], POSITIVE[ENTROPY_RULE_ID] + "  ", f"bearer: '{RANDOM32[::-1]}'",
                  f"jwt_secret = '{RANDOM32}' # {DEFAULT_MARKER}"]
    return "\n".join(lines)


BLOCKS = tuple(_block(f) for f in FAMILIES) + ("def clean():\n    return 1",)


# Tables whose rows are whole texts, with their key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df, TEXT_TABLES[table]) if table in TEXT_TABLES else df


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        F.concat(F.lit("p"), (i % PROJECTS).cast("string")).alias("project"),
        F.concat(F.col("lang"), F.lit("/f"), i.cast("string"), _pick(EXTENSIONS, i)).alias("path"),
        F.concat(F.col("text"), F.lit("\n"), _pick(BLOCKS, i)).alias("content"),
    )


def corpus_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot: some files lose their code block, some gain a line, some are gone."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    body = F.when(i % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("\n"), _pick(BLOCKS, i)))
    tail = F.when(i % 13 == 0, F.lit("\nadded = 1")).otherwise(F.lit(""))
    return (
        corpus_files(spark, sf_dir).select("doc_id", "project", "path")
        .join(d.select("doc_id", F.concat("text", body, tail).alias("content")), "doc_id")
        .filter(F.col("doc_id") % 17 != 0)
    )


def corpus_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot in which files are gone, moved, moved and edited, copied, copied and edited, or new."""
    files, i = corpus_files(spark, sf_dir), F.col("doc_id")
    kept = F.when(i % 7 == 3, F.concat(F.lit("moved/"), "path")).when(i % 7 == 4, F.concat(F.lit("edit/"), "path")).otherwise(F.col("path"))
    text = F.when(i % 7 == 4, F.concat(F.lit("edited = "), i.cast("string"), F.lit("\n"), "content")).when(i % 13 == 0, F.lit("")).otherwise(F.col("content"))
    one = files.where(i % 17 != 0).select("doc_id", "project", kept.alias("path"), text.alias("content"))
    copies = files.where((i % 5 == 1) & (i % 3 != 0)).select("doc_id", "project", F.concat(F.lit("copy/"), "path").alias("path"), "content")
    other = F.concat("content", F.lit("\nextra = 1\nextra = 2"))
    edits = files.where(i % 5 == 2).select("doc_id", "project", F.concat(F.lit("also/"), "path").alias("path"), other.alias("content"))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat(F.lit("fresh "), i.cast("string"), F.lit(" "), k.cast("string"))), "\n")
    fresh = files.where(i % 19 == 0).select("doc_id", "project", F.concat(F.lit("new/"), "path").alias("path"), lines.alias("content"))
    return one.unionByName(copies).unionByName(edits).unionByName(fresh)


# Directory names for documents whose id says they live under one; read as (directory, modulus).
TREE_NAMES = ("main.py", "notes.md", "App.JSX", ".env.local", "data.bin", "conf.yml", "LICENSE", ".env", "a.b.ts")
EXTRA_DIRS = ("src", "node_modules", "lib/dist", "tests", "env/bin", "docs", "vendor/a")


def corpus_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in many directories, with some file types and names a scan leaves out."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.concat(F.lit("p"), (i % PROJECTS).cast("string")).alias("project"),
        F.concat(_pick(EXTRA_DIRS, i), F.lit("/d"), i.cast("string"), F.lit("/"), _pick(TREE_NAMES, i)).alias("path"),
        F.col("text").alias("content"),
    )


# --- SQL text of the same derivations, for the result check ---------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


CORPUS_SQL = f"""corpus_files AS (
  SELECT doc_id, 'p' || CAST(doc_id % {PROJECTS} AS VARCHAR) AS project,
         lang || '/f' || CAST(doc_id AS VARCHAR) || ({sql_list(EXTENSIONS)})[CAST(doc_id % {len(EXTENSIONS)} AS INT) + 1] AS path,
         ({sql_list(EXTENSIONS)})[CAST(doc_id % {len(EXTENSIONS)} AS INT) + 1] AS raw_ext,
         text || chr(10) || ({sql_list(BLOCKS)})[CAST(doc_id % {len(BLOCKS)} AS INT) + 1] AS content
  FROM documents)"""

TREE_SQL = f"""corpus_tree AS (
  SELECT 'p' || CAST(doc_id % {PROJECTS} AS VARCHAR) AS project,
         ({sql_list(EXTRA_DIRS)})[CAST(doc_id % {len(EXTRA_DIRS)} AS INT) + 1] AS dir,
         ({sql_list(TREE_NAMES)})[CAST(doc_id % {len(TREE_NAMES)} AS INT) + 1] AS name,
         dir || '/d' || CAST(doc_id AS VARCHAR) || '/' || name AS path,
         text AS content
  FROM documents)"""

NEXT_SQL = f"""corpus_next AS (
  SELECT c.doc_id, c.project, c.path,
         d.text || CASE WHEN c.doc_id % 11 = 0 THEN '' ELSE chr(10) || ({sql_list(BLOCKS)})[CAST(c.doc_id % {len(BLOCKS)} AS INT) + 1] END
           || CASE WHEN c.doc_id % 13 = 0 THEN chr(10) || 'added = 1' ELSE '' END AS content, c.raw_ext
  FROM corpus_files c JOIN documents d USING (doc_id) WHERE c.doc_id % 17 <> 0)"""


MOVED_SQL = """corpus_moved AS (
  SELECT project, CASE doc_id % 7 WHEN 3 THEN 'moved/' || path WHEN 4 THEN 'edit/' || path ELSE path END AS path,
         CASE WHEN doc_id % 7 = 4 THEN 'edited = ' || doc_id || chr(10) || content WHEN doc_id % 13 = 0 THEN '' ELSE content END AS content
  FROM corpus_files WHERE doc_id % 17 <> 0
  UNION ALL SELECT project, 'copy/' || path, content FROM corpus_files WHERE doc_id % 5 = 1 AND doc_id % 3 <> 0
  UNION ALL SELECT project, 'also/' || path, content || chr(10) || 'extra = 1' || chr(10) || 'extra = 2' FROM corpus_files WHERE doc_id % 5 = 2
  UNION ALL SELECT project, 'new/' || path, array_to_string(list_transform(range(1, 10), lambda k: 'fresh ' || doc_id || ' ' || k), chr(10))
  FROM corpus_files WHERE doc_id % 19 = 0)"""


# --- commit logs -------------------------------------------------------------------------------

LOG_FILES = 40


def log_path() -> Column:
    i = F.col("doc_id")
    return F.concat(F.lit("src/f"), (i % LOG_FILES).cast("string"), _pick(EXTENSIONS, i))


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, project, path, content, lang): documents as versions of a smaller set of files."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus_files(spark, sf_dir).join(d, "doc_id").select(
        "doc_id", "project", log_path().alias("path"), "content", "lang"
    )


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, seq, line): one commit per document, newest first; each file line is added, kept or removed."""
    v = file_versions(spark, sf_dir)
    newest = read(spark, sf_dir, "documents").agg(F.max("doc_id").alias("newest"))
    i = F.col("doc_id").cast("string")
    head = F.array(
        F.concat(F.lit("COMMIT:"), F.sha1(i.cast("binary"))),
        F.concat(F.lit("AUTHOR:"), F.col("lang")),
        F.concat(F.lit("DATE:"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string")),
        F.concat(F.lit("MSG:change "), i),
        F.lit("END_META"),
        F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path")),
        F.concat(F.lit("+++ b/"), F.col("path")),
    )
    body = F.transform(
        F.split("content", "\n", -1),
        lambda x, p: F.concat(F.when(p % 7 == 6, "-").when(p % 5 == 3, " ").otherwise("+"), x),
    )
    # one row, the highest id: a scalar carried by a broadcast of a single aggregate row
    joined = v.withColumn("one", F.lit(1)).join(F.broadcast(newest.withColumn("one", F.lit(1))), "one")
    return joined.select(
        F.col("project").alias("repo"), "newest", "doc_id", F.posexplode(F.concat(head, body)).alias("pos", "line")
    ).select("repo", ((F.col("newest") - F.col("doc_id")) * 1000000 + F.col("pos")).alias("seq"), "line")


def head_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): each file's newest version; some have lost their code block since."""
    v = file_versions(spark, sf_dir)
    text = read(spark, sf_dir, "documents").select("doc_id", "text")
    last = v.groupBy("project", "path").agg(F.max("doc_id").alias("doc_id"))
    content = F.when(F.col("doc_id") % 11 == 0, F.col("text")).otherwise(F.col("content"))
    return (
        last.join(v.select("doc_id", "content"), "doc_id").join(text, "doc_id")
        .select(F.col("project").alias("repo"), "path", content.alias("content"))
    )


VERSIONS_SQL = f"""file_versions AS (
  SELECT c.doc_id, c.project, c.raw_ext, 'src/f' || CAST(c.doc_id % {LOG_FILES} AS VARCHAR) || c.raw_ext AS path, c.content, d.lang, d.text
  FROM corpus_files c JOIN documents d USING (doc_id))"""

LOG_SQL = """raw_log AS (
  SELECT project AS repo, doc_id, path, lang, (SELECT max(doc_id) FROM documents) AS newest,
         ['COMMIT:' || sha1(CAST(doc_id AS VARCHAR)), 'AUTHOR:' || lang,
          'DATE:' || CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS VARCHAR),
          'MSG:change ' || CAST(doc_id AS VARCHAR), 'END_META', 'diff --git a/' || path || ' b/' || path,
          '+++ b/' || path] AS head,
         string_split(content, chr(10)) AS body
  FROM file_versions),
added AS (
  SELECT repo, doc_id, path, lang, newest, pos, x AS content, (newest - doc_id) * 1000000 + 7 + pos AS seq
  FROM (SELECT repo, doc_id, path, lang, newest, unnest(body) AS x, unnest(range(0, len(body))) AS pos FROM raw_log)
  WHERE pos % 7 <> 6 AND pos % 5 <> 3 AND NOT starts_with(x, '++'))"""


# --- dependency manifests ----------------------------------------------------------------------

PY_LINES = (
    "requests==2.19.0", "Flask>=1.0  # web", "pyyaml", "# note", "huggingface-cli", "-r base.txt", "requets>=1",
    "numpy-tools==0.1", "sklearn", "django[argon2]==2.2", "tensorflow-gpu", "", "requests==2.20.0", "cv2~=4.1",
)
PY_NAMES = ('"requests>=2.19.0"', "'flask'", '"pyyaml==5.1"', '"pandas-utils"', '"urllib2"', '"crypto>=1,<2"')
NPM_DEPS = (
    ("lodash", "4.17.15"), ("left-pad", "*"), ("React-Utils", "latest"), ("axois", "^0.19.0"), ("minimist", "1.2.0"),
    ("crossenv", ""), ("express", "~4.17.0"),
)
ADVISORIES = (
    '{"id":"ADV-1","aliases":["GHSA-1","CVE-2018-0001"],"summary":"credential leak on redirect",'
    '"affected":[{"package":{"ecosystem":"PyPI","name":"requests"},"versions":["2.19.0","2.19.1"],'
    '"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"2.20.0"}]}]}],'
    '"database_specific":{"severity":"MODERATE"}}',
    '{"id":"ADV-2","summary":"code run on load","affected":[{"package":{"ecosystem":"PyPI","name":"PyYAML"},'
    '"versions":["5.1"],"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"3.0"},{"last_affected":"5.3.1"}]}]}],'
    '"database_specific":{"severity":"critical"}}',
    '{"id":"ADV-3","aliases":["CVE-2019-0003"],"summary":"prototype change","affected":[{"package":'
    '{"ecosystem":"npm","name":"lodash"},"versions":["4.17.15"],"ecosystem_specific":{"severity":"important"}}],'
    '"database_specific":{"severity":"LOW"}}',
    '{"id":"ADV-4","aliases":[],"affected":[{"package":{"ecosystem":"npm","name":"minimist"},"versions":["1.2.0"]}]}',
    '{"id":"ADV-5","summary":"path escape","affected":[{"package":{"ecosystem":"PyPI","name":"django"},'
    '"versions":["2.2"]},{"package":{"ecosystem":"npm","name":"express"},"versions":["~4.17.0"]}],'
    '"database_specific":{"severity":"NEGLIGIBLE"}}',
)


def _member(index: int, modulus: int) -> Column:
    return (F.col("c_custkey") + index) % modulus == 0


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): one manifest per customer, its entries picked by the customer's key."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    requirements = F.concat_ws("\n", *[F.when(_member(k, 3), F.lit(x)) for k, x in enumerate(PY_LINES)])
    pyproject = F.concat(
        F.lit('[project]\nname = "x"\ndependencies = [\n'),
        F.concat_ws(",\n", *[F.when(_member(k, 2), F.lit(x)) for k, x in enumerate(PY_NAMES)]),
        F.lit("\n]\n"),
    )

    def entries(offset: int) -> Column:
        return F.concat_ws(",", *[F.when(_member(k + offset, 3), F.lit(f'"{n}":"{v}"')) for k, (n, v) in enumerate(NPM_DEPS)])

    package = F.concat(F.lit('{"dependencies":{'), entries(0), F.lit('},"devDependencies":{'), entries(1), F.lit("}}"))
    kind = key % 3
    name = F.when(kind == 0, "requirements-dev.txt").when(kind == 1, "pyproject.toml").otherwise("package.json")
    folder = F.when(key % 29 == 0, "node_modules/svc").otherwise("svc")
    return c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project"),
        F.concat(folder, key.cast("string"), F.lit("/"), name).alias("path"),
        F.when(kind == 0, requirements).when(kind == 1, pyproject).otherwise(package).alias("content"),
    )


def advisory_rows(spark: SparkSession) -> DataFrame:
    from auditlake.schema import local_table
    from auditlake.sources.advisories import advisories_from_json, read_advisories

    return read_advisories(advisories_from_json(local_table(spark, [(a,) for a in ADVISORIES], "payload string")))


def _sql_picked(values, modulus: int, offset: int = 0) -> str:
    n = len(values)
    return (
        f"list_transform(list_filter(range(0, {n}), lambda k: (c_custkey + k + {offset}) % {modulus} = 0), "
        f"lambda k: ({sql_list(values)})[k + 1])"
    )


_NPM_ENTRIES = [f'"{n}":"{v}"' for n, v in NPM_DEPS]
MANIFEST_SQL = f"""manifests AS (
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS project, c_custkey,
         CASE WHEN c_custkey % 29 = 0 THEN 'node_modules/svc' ELSE 'svc' END || CAST(c_custkey AS VARCHAR) || '/' ||
           CASE c_custkey % 3 WHEN 0 THEN 'requirements-dev.txt' WHEN 1 THEN 'pyproject.toml' ELSE 'package.json' END AS path,
         {_sql_picked(PY_LINES, 3)} AS py_lines,
         {_sql_picked(PY_NAMES, 2)} AS py_names,
         list_concat({_sql_picked(_NPM_ENTRIES, 3)}, {_sql_picked(_NPM_ENTRIES, 3, 1)}) AS npm_entries
  FROM customer),
requirement_rows AS (
  SELECT project, path, trim(unnest(py_lines)) AS line, unnest(range(0, len(py_lines))) AS pos
  FROM manifests WHERE c_custkey % 3 = 0 AND c_custkey % 29 <> 0),
requirement_packages AS (
  SELECT project, path, 'python' AS ecosystem, lower(regexp_extract(line, '^([a-zA-Z0-9_-]+)(?:\\[.*\\])?(?:([=<>!~]+)(.+))?', 1)) AS name, name AS original,
         nullif(trim(regexp_extract(line, '^([a-zA-Z0-9_-]+)(?:\\[.*\\])?(?:([=<>!~]+)(.+))?', 3)), '') AS version, pos
  FROM requirement_rows WHERE line <> '' AND line[1] NOT IN ('#', '-')),
pyproject_rows AS (
  SELECT project, path, unnest(py_names) AS entry, unnest(range(0, len(py_names))) AS pos
  FROM manifests WHERE c_custkey % 3 = 1 AND c_custkey % 29 <> 0),
pyproject_packages AS (
  SELECT project, path, 'python' AS ecosystem, lower(regexp_extract(entry, '([a-zA-Z0-9_-]+)(?:[=<>!~]+([^"'']+))?["'']', 1)) AS name, name AS original,
         nullif(regexp_extract(entry, '([a-zA-Z0-9_-]+)(?:[=<>!~]+([^"'']+))?["'']', 2), '') AS version, pos
  FROM pyproject_rows),
npm_rows AS (
  SELECT project, path, unnest(npm_entries) AS entry, unnest(range(0, len(npm_entries))) AS pos
  FROM manifests WHERE c_custkey % 3 = 2 AND c_custkey % 29 <> 0),
npm_packages AS (
  SELECT project, path, 'npm' AS ecosystem, lower(string_split(entry, '"')[2]) AS name, string_split(entry, '"')[2] AS original,
         string_split(entry, '"')[4] AS version, pos
  FROM npm_rows),
packages AS (
  SELECT project, path, ecosystem, name, max_by(original, pos) AS original, arg_max_null(version, pos) AS version, min(pos) AS pos
  FROM (SELECT * FROM requirement_packages UNION ALL SELECT * FROM pyproject_packages UNION ALL SELECT * FROM npm_packages)
  GROUP BY ALL)"""
