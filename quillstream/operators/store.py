"""Snapshot tables: upserts as keyed merges, insert-if-absent, deep merges, postings, contract checks, enrichment hooks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.ranks import running
from quillstream.operators.tables import written


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Merged snapshot: new values win, even nulls; columns in keep stay as they were; columns in fill take the new value
    only where the old one is null or empty. Nothing is deleted, and doing it twice changes nothing."""
    value = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*value).alias("o"), F.lit(True).alias("had"))
    n = new.select(*keys, F.struct(*value).alias("n"), F.lit(True).alias("has"))
    joined = o.join(n, keys, "full_outer")

    def pick(c: str) -> Column:
        was, now = F.col(f"o.`{c}`"), F.col(f"n.`{c}`")
        if c in fill:
            was_set = was.isNotNull() & (was.cast("string") != "")
            return F.when(F.col("had") & was_set, was).otherwise(F.coalesce(now, was))
        first = F.when(F.col("had"), was) if c in keep else F.when(F.col("has"), now)
        return first.otherwise(now if c in keep else was)

    return joined.select(*keys, *[pick(c).alias(c) for c in value]).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and the new ones whose key is not among them."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys).distinct(), keys, "left_anti"))


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two maps in which the new value of a key wins."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def replace_items(old: DataFrame, new: DataFrame, digest: str = "digest_date") -> DataFrame:
    """All items of the digests in new are replaced by new's."""
    return old.join(new.select(digest).distinct(), digest, "left_anti").unionByName(new)


def upsert_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Clusters by key: the new headline, last_seen and counts win, category and first_seen stay, and a parent_key that was
    known stays where the new one is null."""
    merged = upsert(old, new, ["key"], keep=["category", "first_seen"])
    was = old.select("key", F.col("parent_key").alias("_was"))
    return merged.join(was, "key", "left").withColumn("parent_key", F.coalesce("parent_key", "_was")).drop("_was").select(*old.columns)


def point_members(articles: DataFrame, members: DataFrame) -> DataFrame:
    """Articles with the cluster_key of their cluster (members: url, key); others keep theirs. Of several clusters of one
    url the largest key."""
    to = members.groupBy("url").agg(F.max("key").alias("_to"))
    return articles.join(to, "url", "left").withColumn("cluster_key", F.coalesce("_to", "cluster_key")).select(*articles.columns)


def analysis_rows(analyses: DataFrame, clusters: DataFrame) -> DataFrame:
    """Analyses of known clusters, with what is sorted and filtered by as columns; irrelevant ones have significance 0."""
    known = analyses.join(clusters.select(F.col("key").alias("cluster_key")), "cluster_key", "left_semi")
    return known.withColumns({"democracy_significance": F.when(F.col("relevant"), F.col("significance")).otherwise(0.0), "democracy_net": F.col("net_direction")})


def upsert_analyses(old: DataFrame, analyses: DataFrame, clusters: DataFrame) -> DataFrame:
    """One analysis per cluster: those of known clusters replace what is stored, whole; others are skipped. old has the columns
    of analysis_rows()."""
    new = analysis_rows(analyses, clusters)
    return upsert(old, new.select(*old.columns), ["cluster_key"])


def upsert_registry(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, counts): sources by slug, new values win; counts has one row, inserted."""
    added = new.select("slug").distinct().join(old.select("slug"), "slug", "left_anti").agg(F.count("*").alias("inserted"))
    return upsert(old, new, ["slug"]), added


def save_digests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Digests by date: all new values win, but for a markdown_path that is missing or empty now, which stays as it was."""
    merged = upsert(old, new, ["digest_date"])
    was = old.select("digest_date", F.col("markdown_path").alias("_was"))
    kept = F.coalesce(F.nullif("markdown_path", F.lit("")), "_was")
    return merged.join(was, "digest_date", "left").withColumn("markdown_path", kept).select(*old.columns)


def save_deep_dives(old: DataFrame, new: DataFrame, clusters: DataFrame) -> DataFrame:
    """The deep dive (digest_date, cluster_key, payload) of each date. A stored one gets the new payload and keeps its cluster;
    one that isn't stored is added if its cluster is known. Digests without one now keep theirs."""
    known = new.join(clusters.select(F.col("key").alias("cluster_key")), "cluster_key", "left_semi")
    payload = new.select("digest_date", F.col("payload").alias("_new"), F.lit(True).alias("_has"))
    stored = old.join(payload, "digest_date", "left").withColumn("payload", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("payload"))).select(*old.columns)
    return stored.unionByName(known.join(old.select("digest_date"), "digest_date", "left_anti").select(*old.columns))


def save_items(old: DataFrame, new: DataFrame, clusters: DataFrame) -> DataFrame:
    """Items of the digests in new replace those of their dates; an item of an unknown cluster is skipped."""
    known = new.join(clusters.select("key"), "key", "left_semi").select(*old.columns)
    return old.join(new.select("digest_date").distinct(), "digest_date", "left_anti").unionByName(known)


def merge_translations(digests: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests, stored): partial translations merged into stored digests, language by language.

    digests: digest_date and translations, a map of language to (editorial_note, items, deep_dive), where items maps the key of
    a story to its translation. incoming: run, digest_date, lang, editorial_note, items, deep_dive; runs are merged in their
    order. A run's items win over earlier ones of the same key and leave the others; its note and deep dive win unless they
    are missing or empty. stored: digest_date, lang and whether there was such a digest; where not, nothing is changed.
    Nothing else in a digest changes.
    """
    entry = incoming.select("digest_date", "lang", "run", F.nullif("editorial_note", F.lit("")).alias("note"), F.nullif("deep_dive", F.lit("")).alias("dive"), F.coalesce("items", F.create_map().cast("map<string,string>")).alias("items"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("run")))
    notes = entry.groupBy("digest_date", "lang").agg(last("note").alias("note"), last("dive").alias("dive"))
    items = entry.select("digest_date", "lang", "run", F.explode("items").alias("key", "text")).groupBy("digest_date", "lang", "key").agg(F.max_by("text", "run").alias("text"))
    items = items.groupBy("digest_date", "lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text")))).alias("items"))
    new = notes.join(items, ["digest_date", "lang"], "left")
    new = new.groupBy("digest_date").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("note", "items", "dive").alias("said")))).alias("_new"))
    both = digests.join(new, "digest_date", "left")
    empty = F.create_map().cast("map<string,string>")

    def merged(was: Column, now: Column) -> Column:
        items = merge_maps(F.coalesce(was["items"], empty), F.coalesce(now["items"], empty))
        return F.struct(F.coalesce(now["note"], was["editorial_note"]).alias("editorial_note"), items.alias("items"), F.coalesce(now["dive"], was["deep_dive"]).alias("deep_dive"))

    kind = digests.schema["translations"].dataType
    had = F.coalesce("translations", F.from_json(F.lit("{}"), kind))
    made = F.map_zip_with(had, "_new", lambda _, was, now: F.when(now.isNull(), was).otherwise(merged(was, now)))
    out = both.withColumn("translations", F.when(F.col("_new").isNull(), F.col("translations")).otherwise(made)).select(*digests.columns)
    known = digests.select("digest_date", F.lit(True).alias("stored")).distinct()
    return out, incoming.select("digest_date", "lang").distinct().join(known, "digest_date", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def complete_in(digests: DataFrame, items: DataFrame) -> DataFrame:
    """digest_date, lang, items, translated, complete: every item has its translation, and so have the deep dive and the note,
    where the digest has them. digests: digest_date, editorial_note, deep_dive (of the original) and translations; items:
    digest_date, key. Digests without any translation have no row."""
    n = items.groupBy("digest_date").agg(F.count_distinct("key").alias("items"))
    rows = digests.select("digest_date", F.nullif("editorial_note", F.lit("")).alias("note"), F.nullif("deep_dive", F.lit("")).alias("dive"), F.explode("translations").alias("lang", "t"))
    rows = rows.join(n, "digest_date", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "translated": F.coalesce(F.size(F.map_keys("t.items")), F.lit(0)).cast("long")})
    has = lambda mine, theirs: F.col(mine).isNull() | F.coalesce(F.col(f"t.{theirs}") != "", F.lit(False))
    done = (F.col("translated") >= F.col("items")) & has("dive", "deep_dive") & has("note", "editorial_note")
    return rows.select("digest_date", "lang", "items", "translated", done.alias("complete"))


#: Signals that readers may send.
SIGNALS = ("more", "less", "deep_dive", "irrelevant")


def add_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """Feedback appended; an unknown or missing signal is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown signal "), F.coalesce("signal", F.lit("null"))))
    return old.unionByName(new.withColumn("signal", F.when(F.col("signal").isin(*SIGNALS), F.col("signal")).otherwise(bad)).select(*old.columns))


def to_translate(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items (digest_date, key) that aren't translated yet: a run that was cut off is taken up where it ended."""
    return items.join(done.select("digest_date", "key"), ["digest_date", "key"], "left_anti")


def translation_complete(items: DataFrame, done: DataFrame) -> DataFrame:
    """digest_date, items, translated and whether none is missing."""
    n, t = (d.groupBy("digest_date").agg(F.count_distinct("key").alias(k)) for d, k in ((items, "items"), (done, "translated")))
    return n.join(t, "digest_date", "left").withColumn("translated", F.coalesce("translated", F.lit(0))).withColumn("complete", F.col("translated") >= F.col("items"))


def within_budget(calls: DataFrame, budget: int, order: list[str], tokens: str = "tokens") -> DataFrame:
    """Calls in order while the tokens of those before are below the budget. The sums before a call come from ranges of the
    order and what the ranges before them hold, so no task adds up all calls. Ties of order are decided by all columns."""
    keys = [F.col(f"`{c}`") for c in [*order, *[c for c in calls.columns if c not in order]]]
    return running(calls, keys, F.col(f"`{tokens}`"), "_b").filter(F.col("_b") < budget).drop("_b")


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failed ones (with an error) and tokens of each group."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def overridden(enriched: DataFrame, record: str, pipeline: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Enriched rows whose record (a struct) has the pipeline's own values in some fields, whatever was answered."""
    own = pipeline.select(*keys, F.struct(*fields).alias("_own"))
    changed = F.col(record)
    for f in fields:
        changed = changed.withField(f, F.col(f"_own.{f}"))
    return enriched.join(own, keys).withColumn(record, changed).drop("_own")


def append_once(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that aren't in old, each once."""
    return new.dropDuplicates().join(old, old.columns, "left_anti")


def restore_list(original: Column, translated: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Merge two lists by position; a translation that lost entries is not used."""
    n = F.size(original)
    return F.when(F.size(translated) >= n, F.zip_with(original, F.slice(translated, 1, n), merge)).otherwise(original)


Check = tuple[str, Column]


def bounded(name: str, c: Column, low: float, high: float) -> Check:
    return f"{name}: outside {low:g} to {high:g}", c.isNull() | (c < low) | (c > high)


def at_most(name: str, c: Column, n: int) -> Check:
    return f"{name}: more than {n}", F.coalesce(F.length(c) > n, F.lit(False))


def few(name: str, c: Column, high: int, low: int = 0) -> Check:
    return f"{name}: not {low} to {high} entries", F.coalesce((F.size(c) > high) | (F.size(c) < low), F.lit(low > 0))


def one_of(name: str, c: Column, values: list[str]) -> Check:
    return f"{name}: unknown value", c.isNull() | ~c.isin(values)


def validate(df: DataFrame, checks: list[Check]) -> DataFrame:
    """df with violations (names of broken rules); a record with any is to be rejected whole."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])) if checks else F.array().cast("array<string>"))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def unknown_fields(raw: Column, schema: T.StructType) -> Column:
    """Keys of a JSON object that its contract doesn't have, at every level of nested objects."""
    extra = F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in schema]))
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            inner = unknown_fields(F.get_json_object(raw, f"$.{f.name}"), f.dataType)
            extra = F.concat(extra, _prefixed(inner, f.name + "."))
    return extra


def contract_schema(t: T.DataType) -> dict:
    """JSON Schema of a contract: objects without further fields, those that may not be null required."""
    if isinstance(t, T.StructType):
        return {"type": "object", "additionalProperties": False, "properties": {f.name: contract_schema(f.dataType) for f in t}, "required": [f.name for f in t if not f.nullable]}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": contract_schema(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": "object", "additionalProperties": contract_schema(t.valueType)}
    if isinstance(t, T.DateType | T.TimestampType):
        return {"type": "string", "format": "date" if isinstance(t, T.DateType) else "date-time"}
    if isinstance(t, T.BooleanType):
        return {"type": "boolean"}
    return {"type": "integer" if isinstance(t, T.IntegralType) else "number" if isinstance(t, T.NumericType) else "string"}


def parse_contract(df: DataFrame, column: str, schema: T.StructType, checks: Callable[[Column], list[Check]]) -> DataFrame:
    """record (parsed, null if rejected) and violations of each JSON text: malformed, unknown fields, broken rules."""
    parsed = df.withColumn("_p", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    p = F.col("_p")
    rules = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks(p)]))
    extra = F.transform(unknown_fields(F.col(column), schema), lambda k: F.concat(F.lit("unknown field "), k))
    bad = F.when(F.json_object_keys(F.col(column)).isNull(), F.array(F.lit("malformed"))).otherwise(F.concat(extra, rules))
    return parsed.withColumn("violations", bad).withColumn("record", F.when(F.size("violations") == 0, p)).drop("_p")


class Refused(Exception):
    """A client's answer that asking again won't change."""


def enrich(df: DataFrame, client: Callable[[dict], dict], schema: str, attempts: int = 3, parallel: int | None = None, wait: float = 0.0) -> DataFrame:
    """Each row through a client, with a column error; a failing row is retried after wait, 2 * wait, ... seconds (30 at
    most), a refused one is not; then it is kept with its error. The client is pickled; `parallel` bounds the tasks that
    call it at once."""
    out = T._parse_datatype_string(schema)
    names = [f.name for f in out]
    spread = df.repartition(parallel) if parallel else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                error, got = None, {}
                for attempt in range(attempts):
                    try:
                        got, error = client(row), None
                        break
                    except Exception as e:  # a failed call is a result
                        error = f"{type(e).__name__}: {e}"
                        if isinstance(e, Refused):
                            break
                        if attempt + 1 < attempts:
                            time.sleep(min(30.0, wait * 2**attempt))
                rows.append({**row, **{n: got.get(n) for n in names}, "error": error})
            yield pd.DataFrame(rows, columns=[*pdf.columns, *names, "error"])

    fields = [*df.schema.fields, *out.fields, T.StructField("error", T.StringType())]
    return spread.mapInPandas(run, T.StructType(fields))


def enrich_within(df: DataFrame, client: Callable[[dict], dict], schema: str, budget: int, order: list[str], estimate: Column, spent: str = "tokens", **how) -> tuple[DataFrame, DataFrame]:
    """(answered, left): rows of df through a client, in order, until the budget is spent.

    Calls go out in waves. A wave holds the rows whose estimates (whole numbers, 1 or more) fit into what is left of the
    budget, one row at least while any of it is left; then the tokens that the answers report (the column `spent` of schema,
    null as the estimate) are taken off. A client that never spends more than its estimate so never exceeds the budget. What
    is left is for a later run. Sums are running(), so no task sees all rows.
    """
    keys = [F.col(f"`{c}`") for c in order]
    waiting, used, done = written(df.withColumn("_cost", F.greatest(estimate.cast("long"), F.lit(1))), "waiting"), 0, None
    while used < budget and not waiting.isEmpty():
        placed = written(running(waiting, keys, F.col("_cost"), "_before"), "placed")
        now = (F.col("_before") + F.col("_cost") <= budget - used) | (F.col("_before") == 0)
        asked = placed.filter(now).drop("_before")
        answered = written(enrich(asked, client, schema, **how), "answers")
        used += answered.agg(F.sum(F.coalesce(F.col(spent).cast("long"), F.col("_cost")))).first()[0] or 0
        done = answered if done is None else done.unionByName(answered)
        waiting = placed.filter(~now).drop("_before")
    if done is None:
        done = enrich(waiting.limit(0), client, schema, **how)
    return done.drop("_cost"), waiting.drop("_cost")


def resume(items: DataFrame, done: DataFrame, client: Callable[[dict], dict], schema: str, **how) -> DataFrame:
    """done (digest_date, key and the fields of schema) with what was missing of items and could be had now. An item that
    fails is not in it, so the next run asks again."""
    fresh = written(enrich(to_translate(items, done), client, schema, **how), "answers")
    return done.unionByName(fresh.filter("error is null").select(*done.columns))
