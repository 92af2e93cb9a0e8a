"""What surrounds an answer: plans that are checked before they run, narratives that may only cite, streams of events, tables and charts with gaps. Expressions and joins over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parameters of each operation that a plan may hold.
PARAMETERS = {"add_column": ("series_reference", "column_key"), "deflate_column": ("column_key", "deflator_column_key", "base_date", "convention_reference"), "index_column": ("column_key", "base_date"), "revert_to": ("target_version",)}
PLAN = "array<struct<kind: string, parameters: map<string, string>>>"


def plan_refusal(text: Column, version: Column) -> Column:
    """Why a plan (a JSON array of operations) isn't run from a version on, else null: json, empty, kind, parameters (missing, unknown or empty ones), target (a version that isn't earlier, or a column deflated by itself)."""
    steps = F.from_json(text, PLAN, {"mode": "PERMISSIVE"})
    known = F.create_map(*(x for k, names in PARAMETERS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(names))))))

    def wrong(step: Column, at: Column) -> Column:
        given, need = step["parameters"], F.element_at(known, step["kind"])
        names = F.array_sort(F.map_keys(F.coalesce(given, F.create_map().cast("map<string, string>"))))
        target = F.element_at(given, "target_version").try_cast("int")
        return (
            F.when(step["kind"].isNull() | need.isNull(), "kind")
            .when((names != need) | F.exists(F.map_values(given), lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), "parameters")
            .when((step["kind"] == "revert_to") & ~F.coalesce((target >= 0) & (target < version + at), F.lit(False)), "target")
            .when((step["kind"] == "deflate_column") & (F.element_at(given, "column_key") == F.element_at(given, "deflator_column_key")), "target")
        )

    bad = F.filter(F.transform(steps, wrong), lambda r: r.isNotNull())
    return F.when(steps.isNull(), "json").when(F.size(steps) == 0, "empty").otherwise(F.get(bad, F.lit(0)))


def plan_columns(text: Column, history: Column, series: Column) -> Column:
    """Follows a plan that plan_refusal lets pass through the columns it has at each step. history: the columns (array of keys) of the frame's versions from 0 on, the last of which is the one it starts from; series: what may be added.

    A struct of refusal (unknown_series, taken: an added key that is there already or is the spine's, unknown_column: a key that no version made by then has; else null) and columns (those at the end, null if refused)."""
    steps = F.from_json(text, PLAN, {"mode": "PERMISSIVE"})

    def step(state: Column, one: Column) -> Column:
        kind, now = one["kind"], F.element_at(state["sets"], F.lit(-1))
        given = lambda name: F.try_element_at(one["parameters"], F.lit(name))
        key, by, base, adds, changes = given("column_key"), given("deflator_column_key"), given("base_date"), kind == "add_column", kind.isin("deflate_column", "index_column")
        has = lambda c: F.coalesce(F.array_contains(now, c), F.lit(False))
        why = (
            F.when(state["why"].isNotNull(), state["why"]).when(adds & ~F.coalesce(F.array_contains(series, given("series_reference")), F.lit(False)), "unknown_series")
            .when(adds & ((key == "period") | has(key)), "taken").when(changes & ~has(key) | (kind == "deflate_column") & ~has(by), "unknown_column")
        )
        made = F.when(adds, key).when(kind == "index_column", F.concat(key, F.lit("__index_"), base)).when(kind == "deflate_column", F.concat(key, F.lit("__deflated_by_"), by, F.lit("_"), base))
        then = F.when(kind == "revert_to", F.get(state["sets"], given("target_version").try_cast("int"))).otherwise(F.array_append(now, made))
        return F.struct(F.array_append(state["sets"], F.coalesce(then, now)).alias("sets"), why.alias("why"))

    end = F.aggregate(steps, F.struct(history.alias("sets"), F.lit(None).cast("string").alias("why")), step)
    return F.struct(end["why"].alias("refusal"), F.when(end["why"].isNull(), F.element_at(end["sets"], F.lit(-1))).alias("columns"))


def plan_schema(columns: list[str], series: list[str], base_dates: list[str], conventions: list[str]) -> dict:
    """The JSON schema of plans over a frame: a branch for each operation with its own parameters, and what is named taken from what is there. Without series, or columns, the operations that need them are left out."""
    named = {"series_reference": series, "column_key": columns, "deflator_column_key": columns, "base_date": base_dates, "convention_reference": conventions}
    branches = []
    for kind, names in PARAMETERS.items():
        fields = {n: {"enum": list(named[n])} if n in named and not (n == "column_key" and kind == "add_column") else {"type": "integer", "minimum": 0} if n == "target_version" else {"type": "string", "minLength": 1} for n in names}
        if all(f.get("enum", True) for f in fields.values()):
            branches.append({"type": "object", "additionalProperties": False, "required": ["kind", "parameters"], "properties": {"kind": {"const": kind}, "parameters": {"type": "object", "additionalProperties": False, "required": list(names), "properties": fields}}})
    return {"type": "array", "minItems": 1, "items": {"anyOf": branches}}


def narrative_refusal(told: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, unknown, uncited, accepted): statements that a narrative (told: id, statement) makes and no evidence (id, finding, statement, active) has word for word, and active findings it leaves out. Only one without either is accepted."""
    said = told.select("id", "statement").distinct()
    extra = said.join(evidence.select("id", "statement").distinct(), ["id", "statement"], "left_anti").groupBy("id").agg(F.count("*").alias("unknown"))
    left = evidence.where("active").join(said, ["id", "statement"], "left_anti").groupBy("id").agg(F.count("*").alias("uncited"))
    every = said.select("id").union(evidence.select("id")).distinct().join(extra, "id", "left").join(left, "id", "left")
    out = every.select("id", F.coalesce("unknown", F.lit(0)).alias("unknown"), F.coalesce("uncited", F.lit(0)).alias("uncited"))
    return out.withColumn("accepted", (F.col("unknown") == 0) & (F.col("uncited") == 0))


def events(body: Column) -> Column:
    """The events of a stream's body: blocks parted by an empty line, with the last event line (else message) and the data lines joined by line ends. Blocks without data, and one that isn't finished, are left out; lines that begin with a colon are remarks."""
    text = F.regexp_replace(body, "\r\n?", "\n")
    blocks = F.split(F.regexp_replace(text, r"\n*$", ""), "\n\n+")
    done = F.when(F.endswith(text, F.lit("\n\n")), blocks).otherwise(F.slice(blocks, F.lit(1), F.greatest(F.lit(0), F.size(blocks) - 1)))

    def one(block: Column) -> Column:
        field = lambda name: F.transform(F.filter(F.split(block, "\n"), lambda x: F.startswith(x, F.lit(name + ":"))), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
        kinds, data = field("event"), field("data")
        return F.struct(F.coalesce(F.get(kinds, F.size(kinds) - 1), F.lit("message")).alias("event"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))

    return F.filter(F.transform(done, one), lambda e: e["data"].isNotNull())


def batches(images: DataFrame, cache: DataFrame, most: int = 3) -> DataFrame:
    """(digest, batch) of the distinct images (document, page, digest) that a cache (digest) doesn't hold, in batches of at most most of one document, by their first page. An image that several documents share is read with the first of them."""
    own = images.groupBy("digest").agg(F.min(F.struct("document", "page")).alias("f")).join(cache.select("digest"), "digest", "left_anti").select("digest", "f.*")
    by = Window.partitionBy("document").orderBy("page", "digest")
    return own.select("digest", "document", F.floor((F.row_number().over(by) - 1) / most).alias("batch"))


def cell(value: Column) -> Column:
    """A figure as a table shows it; what isn't known is a dash."""
    return F.when(value.isNull(), "—").otherwise(F.format_number(value, 2))


def visible(html: Column) -> Column:
    """Roughly what a page shows without being rendered: its text without scripts, styles and marks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), r"\s+", " "))
