"""What kind of project a corpus holds, and which checks to run on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.operators.select import under_dirs

# Directories a profile never enters and root manifests it reads (in this order).
PROFILE_SKIP_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv")
SAMPLED = (
    "package.json", "requirements.txt", "pyproject.toml", "Gemfile", "pom.xml", "go.mod", "Cargo.toml",
    ".env.example", "docker-compose.yml",
)

# Indicators. Framework indicators equal a file name or path, or occur in the sample.
FRAMEWORKS = {
    "django": ("settings.py", "urls.py", "wsgi.py", "asgi.py"),
    "flask": ("app.py", "flask"),
    "fastapi": ("fastapi", "uvicorn"),
    "streamlit": ("streamlit",),
    "react": ("react", "jsx", "tsx", "create-react-app"),
    "next.js": ("next.config", "_app.js", "_app.tsx", "pages/", "app/"),
    "vue": ("vue", ".vue", "nuxt"),
    "express": ("express", "app.listen"),
    "nest.js": ("@nestjs",),
    "rails": ("Gemfile", "config/routes.rb"),
    "spring": ("pom.xml", "application.properties"),
}
DATABASES = {
    "postgresql": ("psycopg", "pg", "postgres"),
    "mysql": ("mysql", "pymysql"),
    "mongodb": ("mongoose", "pymongo", "mongodb"),
    "sqlite": ("sqlite3", "sqlite"),
    "redis": ("redis", "ioredis"),
    "supabase": ("supabase", "@supabase/supabase-js"),
    "firebase": ("firebase", "firestore"),
    "prisma": ("prisma",),
}
CLOUDS = {
    "aws": ("boto3", "aws-sdk", "@aws-sdk"),
    "gcp": ("google-cloud", "@google-cloud"),
    "azure": ("azure", "@azure"),
    "vercel": ("vercel", "@vercel"),
    "netlify": ("netlify",),
    "railway": ("railway",),
    "render": ("render",),
    "supabase": ("supabase",),
    "firebase": ("firebase",),
}
AI_TOOLS = {
    "lovable": (".lovable", "lovable.json"),
    "replit": (".replit", "replit.nix"),
    "cursor": (".cursor", ".cursorignore", ".cursorrules"),
    "bolt": (".bolt",),
    "v0": ("v0.dev",),
    "windsurf": (".windsurf", ".codeium"),
}
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JavaScript/React",
    ".tsx": "TypeScript/React", ".vue": "Vue", ".rb": "Ruby", ".java": "Java", ".go": "Go", ".rs": "Rust",
    ".php": "PHP",
}
# File name that gives the project type when no web or Python manifest does.
TYPE_FILES = (("Gemfile", "ruby/rails"), ("pom.xml", "java"), ("build.gradle", "java"), ("go.mod", "go"), ("Cargo.toml", "rust"))
WEB_FRAMEWORKS = ("flask", "django", "fastapi", "express", "next.js", "react", "vue")


def _any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _listed(flags: dict[str, Column]) -> Column:
    """Names whose flag holds, in the order given."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


def profiled(files: DataFrame) -> DataFrame:
    return files.filter(~under_dirs(F.col("path"), PROFILE_SKIP_DIRS))


def content_sample(files: DataFrame) -> DataFrame:
    """(project, sample): the root manifests, whole, in fixed order, joined by line ends.

    One slot per manifest name keeps the aggregate to nine texts, whatever the corpus holds.
    """
    cut = files.filter(F.col("path").isin(*SAMPLED)).select("project", "path", F.col("content").alias("text"))
    slots = [F.max(F.when(F.col("path") == name, F.col("text"))).alias(f"s{i}") for i, name in enumerate(SAMPLED)]
    grouped = cut.groupBy("project").agg(*slots)
    return grouped.select("project", F.concat_ws("\n", *[f"s{i}" for i in range(len(SAMPLED))]).alias("sample"))


def name_facts(files: DataFrame) -> DataFrame:
    """Per project what its file names say, as flags. Reads paths only; partial flags are merged."""
    path = F.col("path")
    name = tx.file_name(path)

    def has_name(*wanted: str) -> Column:
        return F.bool_or(name.isin(*wanted) | path.isin(*wanted))

    def has_part(part: str) -> Column:
        return F.bool_or(F.contains(path, F.lit(part)))

    facts = {
        "package_json": has_name("package.json"),
        "python_manifest": has_name("requirements.txt", "pyproject.toml"),
        "part_next": has_part("next"),
        "part_vue": has_part(".vue"),
        "part_settings": has_part("settings.py"),
        "part_app": has_part("app.py"),
        **{f"type_{i}": has_name(f) for i, (f, _) in enumerate(TYPE_FILES)},
        **{
            f"fw_{i}": F.bool_or(F.lower(name).isin(*low) | F.lower(path).isin(*low))
            for i, low in enumerate([[w.lower() for w in words] for words in FRAMEWORKS.values()])
        },
        **{
            f"ai_{i}": F.bool_or(_any_of([F.contains(path, F.lit(w)) for w in words]))
            for i, words in enumerate(AI_TOOLS.values())
        },
        **{f"lang_{i}": F.bool_or(tx.file_ext(path) == ext) for i, ext in enumerate(LANGUAGES)},
    }
    return profiled(files).groupBy("project").agg(*[c.alias(n) for n, c in facts.items()])


def project_type(facts: dict[str, Column]) -> Column:
    out = (
        F.when(facts["package_json"] & facts["part_next"], "next.js")
        .when(facts["package_json"] & facts["part_vue"], "vue")
        .when(facts["package_json"], "node.js")
        .when(facts["python_manifest"] & facts["part_settings"], "django")
        .when(facts["python_manifest"] & facts["part_app"], "flask/fastapi")
        .when(facts["python_manifest"], "python")
    )
    for i, (_, kind) in enumerate(TYPE_FILES):
        out = out.when(facts[f"type_{i}"], kind)
    return out.otherwise("unknown")


def recommend_checks(frameworks: Column, databases: Column, clouds: Column, ai_tools: Column) -> Column:
    """Ordered checks without repeats; one builder's projects get the cloud check first."""

    def when(test: Column, *checks: str) -> Column:
        return F.when(test, F.array(*[F.lit(c) for c in checks])).otherwise(F.array().cast("array<string>"))

    web = F.arrays_overlap(frameworks, F.array(*[F.lit(f) for f in WEB_FRAMEWORKS]))
    hosted = (F.size(clouds) > 0) | F.array_contains(databases, "supabase") | F.array_contains(databases, "firebase")
    return F.array_distinct(F.concat(
        when(F.array_contains(ai_tools, "lovable"), "cloud"),
        F.array(F.lit("secrets")),
        when(F.size(databases) > 0, "injection"),
        when(web, "xss", "auth", "cors"),
        when(hosted, "cloud"),
        when(F.array_contains(frameworks, "django"), "crypto"),
        when(F.size(ai_tools) > 0, "data"),
    ))


def profile_projects(files: DataFrame) -> DataFrame:
    """(project, project_type, frameworks, languages, databases, cloud_services, ai_tool_indicators, recommended_checks).

    Two passes: one over paths, one over the root manifests only, so other contents are not read.
    """
    joined = name_facts(files).join(content_sample(files), "project", "left")
    facts = {c: F.col(c) for c in joined.columns}
    sample = F.lower(F.coalesce(F.col("sample"), F.lit("")))

    def in_sample(words) -> Column:
        return _any_of([F.contains(F.col("lowered"), F.lit(w.lower())) for w in words])

    profile = joined.withColumn("lowered", sample).select(
        "project",
        project_type(facts).alias("project_type"),
        _listed({k: facts[f"fw_{i}"] | in_sample(w) for i, (k, w) in enumerate(FRAMEWORKS.items())}).alias("frameworks"),
        F.array_sort(_listed({k: facts[f"lang_{i}"] for i, k in enumerate(LANGUAGES.values())})).alias("languages"),
        _listed({k: in_sample(w) for k, w in DATABASES.items()}).alias("databases"),
        _listed({k: in_sample(w) for k, w in CLOUDS.items()}).alias("cloud_services"),
        _listed({k: facts[f"ai_{i}"] for i, k in enumerate(AI_TOOLS)}).alias("ai_tool_indicators"),
    )
    checks = recommend_checks(
        F.col("frameworks"), F.col("databases"), F.col("cloud_services"), F.col("ai_tool_indicators")
    )
    return profile.withColumn("recommended_checks", checks)
