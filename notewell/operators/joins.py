"""Joins.

No broadcast hints: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and adaptive execution splits skewed
partitions otherwise. Lists that must be inlined are length-checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell import fixed_values as fv
from notewell.functions import matching as m
from notewell.functions import scalars, similarity
from notewell.functions.packs import RulePack
from notewell.session import cut_lineage

MAX_VOCABULARY = 5000


def _prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def enrich_notes(notes: DataFrame, users: DataFrame, clients: DataFrame, actions: DataFrame) -> DataFrame:
    """Notes with advisor, client, action and the action's manager; missing sides get defaults."""
    advisor = users.select(
        F.col("id").alias("advisor_id"),
        F.coalesce("full_name", "email").alias("__advisor_name"),
        F.col("store").alias("__advisor_store"),
    )
    client = clients.select(
        F.col("id").alias("client_id"), F.col("name").alias("__client_name"), F.col("vic_status").alias("__vic")
    )
    manager = users.select(
        F.col("id").alias("manager_id"), F.coalesce("full_name", "email").alias("manager_name")
    )
    action = actions.select(
        F.col("note_id").alias("id"),
        "manager_id",
        F.lower(F.trim("action_type")).alias("__action_type"),
        F.lower(F.trim("status")).alias("__action_status"),
        F.col("updated_at").alias("action_updated_at"),
    )
    return (
        notes.join(advisor, "advisor_id", "left")
        .join(client, "client_id", "left")
        .join(action, "id", "left")
        .join(manager, "manager_id", "left")
        .withColumns(
            {
                "advisor_name": F.coalesce("__advisor_name", F.lit("Inconnu")),
                "advisor_store": F.coalesce("__advisor_store", F.lit("N/A")),
                "client_name": F.coalesce("__client_name", F.lit("Client inconnu")),
                "vip_label": F.coalesce("__vic", F.lit("Standard")),
                "action_status": F.coalesce("__action_status", F.lit("open")),
                "action_type": F.coalesce("__action_type", F.lit("")),
            }
        )
        .drop("__advisor_name", "__advisor_store", "__client_name", "__vic", "__action_status", "__action_type")
    )


def recordings(notes: DataFrame, users: DataFrame, clients: DataFrame) -> DataFrame:
    """Notes that have both an advisor and a client."""
    advisor = _prefixed(users, "advisor", ["id", "full_name", "store"])
    client = _prefixed(clients, "client", ["id", "name", "vic_status"])
    return notes.join(advisor, "advisor_id").join(client, "client_id")


def recent_actions(actions: DataFrame, notes: DataFrame, end, days: int | None = None, status: str | None = None,
                   ids: Sequence[int] | None = None, *, limit: int) -> DataFrame:
    """Actions, newest first, whose note is at most ``days`` old."""
    out = actions
    if ids is not None:
        out = out.where(F.col("note_id").isin(list(ids)))
    if status:
        out = out.where(F.col("status") == status)
    if days is not None:
        fresh = notes.where(F.col("timestamp") >= F.lit(end) - F.expr(f"INTERVAL {int(days)} DAYS"))
        out = out.join(fresh.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return out.orderBy(F.col("updated_at").desc(), F.col("note_id")).limit(limit)


def merge_results(notes: DataFrame, results: DataFrame, id_col: str = "id") -> DataFrame:
    """Extraction results back on their notes; notes without a result keep nulls."""
    extra = [c for c in results.columns if c == id_col or c not in notes.columns]
    return notes.join(results.select(*extra), id_col, "left")


def user_inventory(users: DataFrame, notes: DataFrame) -> DataFrame:
    """Users with their note count and last note; the notes are aggregated before the join."""
    per_user = notes.groupBy(F.col("advisor_id").alias("id")).agg(
        F.count("*").alias("notes_count"), F.max("timestamp").alias("last_note_at")
    )
    return users.join(per_user, "id", "left").withColumns(
        {
            "notes_count": F.coalesce("notes_count", F.lit(0)),
            "role": F.lower(F.trim(F.coalesce("role", F.lit("advisor")))),
            "score": F.coalesce("score", F.lit(0)),
        }
    )


def tag_by_lexicon(df: DataFrame, text: str, pack: RulePack, out: str = "tags") -> DataFrame:
    """Tags whose keywords occur with alphanumeric boundaries; for packs small enough to inline."""
    return df.withColumn(out, pack.matching(F.lower(F.coalesce(F.col(text), F.lit("")))))


def _literal(keyword: Column) -> Column:
    """A regular expression for the keyword alone, with the boundaries of :meth:`RulePack.from_keywords`."""
    quoted = F.regexp_replace(keyword, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))


def tag_by_lexicon_table(df: DataFrame, lexicon: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, tag) rows from a lexicon table ``(tag, keyword)`` of any size and keywords of any length.

    Every keyword is looked up by its longest word, which stands whole in each text that holds
    the keyword; candidates are then verified on the text with the inline form's boundaries.
    A keyword without a letter or digit is tried on every text. A keyword under several tags
    belongs to the one with the largest ``position``, if the lexicon has that column, else to
    the one that sorts last. ``id_col`` names a row.
    """
    place = F.struct("position", "tag") if "position" in lexicon.columns else F.col("tag")
    owned = lexicon.withColumn("__keyword", F.lower(F.trim("keyword"))).where("__keyword != ''").groupBy("__keyword").agg(F.max_by("tag", place).alias("tag"))

    def words_of(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    longest = F.aggregate(words_of(F.col("__keyword")), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    keys = owned.withColumn("__word", longest)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    texts = df.select(id_col, low.alias("__low"))
    words = texts.select(id_col, F.explode(F.array_distinct(F.concat(words_of(F.col("__low")), F.array(F.lit(""))))).alias("__word"))
    candidates = words.join(keys, "__word").select(id_col, "__keyword", "tag")
    found = candidates.join(texts, id_col).where(F.col("__low").contains(F.col("__keyword")) & F.regexp_like("__low", _literal(F.col("__keyword"))))
    return found.select(id_col, "tag").distinct()


def tag_by_lexicon_trie(df: DataFrame, lexicon: DataFrame, id_col: str, text: str, salts: int = 8) -> DataFrame:
    """(id, tag) rows as :func:`tag_by_lexicon_table` gives them, by walking a trie of the keywords' words.

    The nodes of level k are the distinct beginnings of k words, with what stands between the words. Every
    word of a text is a row with the few words behind it, as many as the longest keyword has, so no row
    carries a text. At each level the rows whose words so far are a node go on, and those whose words are
    a whole keyword give its tag, if also what stands before and behind is that of the keyword. The joins are
    on words that occur in both sides, spread over ``salts`` parts, so a frequent word is no key of one task.
    Keywords without a letter or digit meet the pieces between words by their length.
    """
    place = F.struct("position", "tag") if "position" in lexicon.columns else F.col("tag")
    owned = lexicon.withColumn("__keyword", F.lower(F.trim("keyword"))).where("__keyword != ''").groupBy("__keyword").agg(F.max_by("tag", place).alias("tag"))
    word, both = r"[\p{L}\p{N}]+", F.lit("")

    def pieces(c: Column) -> tuple[Column, Column]:
        """Words, and what stands before, between and behind them (one more)."""
        return F.regexp_extract_all(c, F.lit(word), F.lit(0)), F.split(c, word, -1)

    words, seps = pieces(F.col("__keyword"))
    keys = cut_lineage(owned.select("tag", "__keyword", words.alias("__words"), seps.alias("__seps")), "keywords")
    longest, lengths = keys.agg(F.max(F.size("__words")), F.collect_set(F.when(F.size("__words") == 0, F.length("__keyword")))).first()
    longest = longest or 0

    def path(k: int) -> Column:
        """The first ``k`` words with what stands between them."""
        return F.concat(*[part for j in range(k) for part in (([F.element_at("__seps", j + 1)] if j else []) + [F.element_at("__words", j + 1)])])

    words, seps = pieces(F.lower(F.coalesce(F.col(text), F.lit(""))))
    whole = df.select(F.col(id_col), words.alias("__w"), seps.alias("__s"))
    at = F.posexplode(F.transform("__w", lambda w, i: F.struct(
        F.slice("__w", i + 1, F.lit(max(longest, 1))).alias("words"), F.slice("__s", i + 1, F.lit(longest + 1)).alias("seps"), (i + F.lit(longest) >= F.size("__w")).alias("ends"),
    ))).alias("__at", "__run")
    alive = whole.select(id_col, at).select(id_col, "__at", F.col("__run.words").alias("__words"), F.col("__run.seps").alias("__seps"), F.col("__run.ends").alias("__ends"))
    alive = alive.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col), "__at"), F.lit(salts)))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("__salt")
    found = []
    for k in range(1, longest + 1):
        own = [F.element_at("__seps", 1).alias("__lead"), F.element_at("__seps", k + 1).alias("__tail")]
        nodes = keys.where(F.size("__words") >= k).select(path(k).alias("__path"), (F.size("__words") > k).alias("__more")).groupBy("__path").agg(F.max("__more").alias("__more"))
        last = keys.where(F.size("__words") == k).select(path(k).alias("__path"), *own, "tag")
        rows = alive.where(F.size("__words") >= k).withColumn("__path", path(k))
        alive = cut_lineage(rows.join(nodes.select("*", spread), ["__path", "__salt"]), "trie-level")
        before, behind = F.element_at("__seps", 1), F.element_at("__seps", k + 1)
        first, end = F.col("__at") == 0, F.col("__ends") & (F.size("__words") == k)
        fits = before.endswith(F.col("__lead")) & ((F.col("__lead") == both) | first | (F.length(before) > F.length("__lead")))
        fits &= behind.startswith(F.col("__tail")) & ((F.col("__tail") == both) | end | (F.length(behind) > F.length("__tail")))
        found.append(alive.join(last.select("*", spread), ["__path", "__salt"]).where(fits).select(id_col, "tag"))
        alive = alive.where("__more").drop("__path", "__more")
    if lengths:
        between = whole.select(id_col, F.posexplode("__s").alias("__at", "__sep"), (F.size("__s") - 1).alias("__last")).where("__sep != ''")
        cut = F.flatten(F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.length("__sep")), lambda i: (i + n - 1 <= F.length("__sep")) & ((i > 1) | (F.col("__at") == 0)) & ((i + n - 1 < F.length("__sep")) | (F.col("__at") == F.col("__last")))),
            lambda i: F.substring(F.col("__sep"), i, n),
        )))
        parts = between.select(id_col, F.explode(F.array_distinct(cut)).alias("__keyword"))
        found.append(parts.join(keys.where(F.size("__words") == 0).select("__keyword", "tag"), "__keyword").select(id_col, "tag"))
    if not found:
        return df.select(F.col(id_col), F.lit("").alias("tag")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def dynamic_tag(tag: Column) -> Column:
    out = F.lit(False)
    for prefix in fv.DYNAMIC_TAG_PREFIXES:
        out = out | tag.startswith(prefix)
    return out


def known_tags(tags: DataFrame, core: DataFrame, tag: str = "tag") -> DataFrame:
    """Rows whose tag is a core tag or a dynamic relation tag, flagged in ``known``."""
    listed = core.select(F.col(core.columns[-1]).alias(tag)).distinct().withColumn("__listed", F.lit(True))
    return (
        tags.join(listed, tag, "left")
        .withColumn("known", F.coalesce("__listed", F.lit(False)) | dynamic_tag(F.col(tag)))
        .drop("__listed")
    )


def split_known_tags(tags: DataFrame, core: DataFrame, tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    flagged = known_tags(tags, core, tag)
    return flagged.where("known").drop("known"), flagged.where("NOT known").drop("known")


def normalize_tags(tags: DataFrame, vocabulary: Sequence[str], aliases: Mapping[str, str] | None = None,
                   cutoff: float = fv.TAG_RATIO, tag: str = "tag") -> DataFrame:
    """Adds ``normalized``: exact core tag, else alias, else the closest core tag, else null.

    Only the distinct tags that neither rule settles reach the similarity function, and
    each of them once. ``vocabulary`` is the taxonomy and is length-checked.
    """
    words = list(dict.fromkeys(vocabulary))
    if len(words) > MAX_VOCABULARY:
        raise ValueError(f"taxonomy of {len(words)} tags exceeds {MAX_VOCABULARY}")
    aliases = fv.TAG_ALIASES if aliases is None else aliases
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    alias_of = F.try_element_at(F.create_map(*pairs), F.lower(tag)) if pairs else F.lit(None).cast("string")
    exact = F.when(F.col(tag).isin(words) | dynamic_tag(F.col(tag)), F.col(tag))
    distinct = tags.select(tag).where(F.col(tag).isNotNull()).distinct().withColumn(
        "__rule", F.coalesce(exact, alias_of)
    )
    fuzzy = distinct.where("__rule IS NULL").select(
        tag, similarity.closest_of(F.col(tag), words, cutoff).alias("normalized")
    )
    settled = distinct.where("__rule IS NOT NULL").select(tag, F.col("__rule").alias("normalized"))
    return tags.join(settled.unionAll(fuzzy), tag, "left")


def reuse_results(notes: DataFrame, results: DataFrame, now, step: str, text: str = "text",
                  ttl_seconds: int = fv.REUSE_TTL_SECONDS, payload: str = "result", salt: str = "v1") -> DataFrame:
    """Notes with the newest stored result of the same normalised text, if it is fresh enough.

    ``results`` has ``cache_key``, ``cached_at`` and the payload column. Adds ``cache_key``,
    the payload and ``from_cache``; misses are the rows with ``from_cache`` false.
    """
    fresh = results.where(F.col("cached_at") >= F.lit(now) - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
    latest = fresh.groupBy("cache_key").agg(F.max_by(payload, "cached_at").alias(payload))
    keyed = notes.withColumn("cache_key", scalars.text_key(F.col(text), step, salt))
    return keyed.join(latest.withColumn("__hit", F.lit(True)), "cache_key", "left").withColumn(
        "from_cache", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")


def reuse_as_of(notes: DataFrame, results: DataFrame, step: str, text: str = "text", ts: str = "ts", ttl_seconds: int = fv.REUSE_TTL_SECONDS,
                payload: str = "result", salt: str = "v1", chunk: str = "hour") -> DataFrame:
    """Notes with the newest result of the same normalised text that was stored at or before the note's own time, not longer than the time to live ago.

    ``results`` has ``cache_key``, ``cached_at`` and the payload; of results of one time the largest payload counts.
    Adds ``cache_key``, ``cached_at``, the payload and ``from_cache``. Notes and results of a key are merged
    into time lines of one ``chunk`` each; a chunk starts with the last result of the chunks before it, so
    a key that holds much of the data meets in no task with more than its rows of a chunk. A note without a time has no hit.
    """
    value = F.struct(F.col("cached_at"), F.col(payload).alias("__payload"))
    keyed = notes.withColumn("cache_key", scalars.text_key(F.col(text), step, salt))
    columns = keyed.columns
    stored = results.where("cached_at IS NOT NULL").groupBy("cache_key", F.date_trunc(chunk, "cached_at").alias("__chunk"), "cached_at").agg(F.max(payload).alias(payload))
    asked = keyed.select("cache_key", F.date_trunc(chunk, F.col(ts)).alias("__chunk"), F.col(ts).alias("__ts"), F.struct(*columns).alias("__note"))
    last = stored.groupBy("cache_key", "__chunk").agg(F.max(value).alias("__last"))
    chunks = last.unionByName(asked.where("__chunk IS NOT NULL").select("cache_key", "__chunk").distinct(), allowMissingColumns=True)
    chunks = chunks.groupBy("cache_key", "__chunk").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy("cache_key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("cache_key", "__chunk", F.last("__last", ignorenulls=True).over(earlier).alias("__value")).where("__value IS NOT NULL")
    line = (
        carried.withColumns({"__kind": F.lit(0), "__ts": F.col("__chunk")})
        .unionByName(stored.select("cache_key", "__chunk", value.alias("__value"), F.lit(1).alias("__kind"), F.col("cached_at").alias("__ts")))
        .unionByName(asked.withColumn("__kind", F.lit(2)), allowMissingColumns=True)
    )
    so_far = Window.partitionBy("cache_key", "__chunk").orderBy("__ts", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = line.withColumn("__hit", F.last("__value", ignorenulls=True).over(so_far)).where("__kind = 2")
    fresh = F.col("__hit.cached_at") >= F.col("__ts") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    hit = F.when(fresh, F.col("__hit"))
    return held.select(*[F.col(f"__note.{c}").alias(c) for c in columns], hit["cached_at"].alias("cached_at"), hit["__payload"].alias(payload), F.coalesce(fresh, F.lit(False)).alias("from_cache"))


def with_stock(matches: DataFrame, stock: DataFrame) -> DataFrame:
    """``in_stock`` is false only for a stock of exactly zero; unknown items count as in stock."""
    known = stock.select("sku", F.col("stock").alias("__stock"))
    return matches.join(known, "sku", "left").withColumn(
        "in_stock", F.coalesce("__stock", F.lit(-1)) != 0
    ).drop("__stock")


def _grams(text: Column, size: Column) -> Column:
    n = F.length(text)
    return F.when(
        n >= size,
        F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size))),
    ).otherwise(m.empty_strings())


GRAM_SIZES = (6, 12, 24)


def contains_join(needles: DataFrame, haystack: DataFrame, needle: str, hay: str, hay_id: str, size: int = 3) -> DataFrame:
    """For every distinct needle the smallest ``hay_id`` whose text contains it (case-insensitive).

    A substring join without a cross join. Every gram of a needle occurs in every text that
    contains it, so joining on a single gram loses nothing; each needle uses its rarest gram,
    which keeps frequent grams out of the join. Candidates are verified.
    A needle's grams are of the largest of ``size`` and ``GRAM_SIZES`` that it has, so that the candidates of long needles
    do not grow with the texts that share a few letters; needles shorter than ``size`` use their own length.
    Both sides may be large, so they meet by sorting and neither is sent to every task.
    """
    n = needles.select(F.lower(needle).alias("__needle")).where(F.length("__needle") > 0).distinct()
    h = haystack.select(F.col(hay_id), F.lower(hay).alias("__hay"))
    wanted_size = F.least(F.length("__needle"), F.lit(size))
    for larger in sorted(s for s in GRAM_SIZES if s > size):
        wanted_size = F.when(F.length("__needle") >= larger, F.lit(larger)).otherwise(wanted_size)
    n = cut_lineage(n.withColumn("__size", wanted_size), "needles")
    sizes = sorted(r["__size"] for r in n.select("__size").distinct().collect())  # a handful of lengths
    if not sizes:
        return h.select(F.lit(None).cast("string").alias(needle), hay_id).limit(0)
    needed = n.select("__needle", F.explode(_grams(F.col("__needle"), F.col("__size"))).alias("__gram"))
    gram_rows = h.select(hay_id, F.explode(F.concat(*[_grams(F.col("__hay"), F.lit(s)) for s in sizes])).alias("__gram"))  # without the text
    gram_rows = gram_rows.join(needed.select("__gram").distinct().hint("merge"), "__gram", "left_semi")
    frequency = gram_rows.groupBy("__gram").agg(F.count("*").alias("__freq"))
    rarest = needed.join(frequency.hint("merge"), "__gram", "left").groupBy("__needle").agg(
        F.min_by("__gram", F.struct(F.coalesce("__freq", F.lit(0)), F.col("__gram"))).alias("__gram")
    )
    return (
        rarest.join(gram_rows.hint("merge"), "__gram").select("__needle", hay_id)
        .join(h.hint("merge"), hay_id)
        .where(F.col("__hay").contains(F.col("__needle")))
        .groupBy("__needle")
        .agg(F.min(hay_id).alias(hay_id))
        .withColumnRenamed("__needle", needle)
    )
