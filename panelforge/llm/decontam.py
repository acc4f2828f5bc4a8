"""Benchmark decontamination by template canonicalisation, as DataFrame expressions only.

Every word becomes a template token: numbers, units after numbers and names
(capitalised words inside a sentence) become typed placeholders, other words
lose their case and closing marks. Windows of template tokens of documents and
benchmark items are hash-joined, so a question whose numbers or names were
swapped still matches. Matches are lined up by diagonal (place in the document
less place in the item); a diagonal counts only if each slot value of the item
always meets the same value of the document and the other way round. A document
leaks an item if it holds at least ``LEAST_SHARE`` of the item's windows.

Scale: the item side is aggregated and counted; up to ``BROADCAST_WINDOWS``
windows it is broadcast, so documents' windows meet it where they are read and
only matches are shuffled. Beyond that both sides are shuffled by window hash,
and adaptive execution splits hot windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE_CLASS, checkpoint
from panelforge.llm.quality_rules import let, words_of

WINDOW = 5
LEAST_SHARE = 0.8
#: Literal words that a window must have: placeholders alone say nothing about an item.
LEAST_LITERALS = 2
#: Windows of the benchmark (about 100 bytes each) up to which they are broadcast.
BROADCAST_WINDOWS = 500_000
#: Units that follow a number: fixed values.
UNITS = [
    "%", "percent", "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "ft", "yards", "miles", "mile", "mg", "g", "kg", "grams", "gram", "kilograms",
    "pounds", "pound", "lb", "lbs", "ounces", "oz", "ml", "l", "liters", "liter", "litres", "litre", "gallons", "gallon", "seconds", "second", "minutes",
    "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "cent", "euros", "euro",
    "degrees", "degree", "mph", "kmh", "meters", "meter", "metres", "metre", "kilometers", "kilometres", "square", "cubic",
]
#: Stripped from a word; with white space, from a text.
MARKS = ".,;:!?\"'()[]{} \t\n\x0b\x0c\r"


def template(words: Column) -> Column:
    """One struct (t: template token, v: the value in a slot, else null) a word."""

    literal = lambda x: F.struct(x.alias("t"), F.lit(None).cast("string").alias("v"))

    def marked(w: Column, i: Column, bare: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1))
        low = F.lower(bare)
        slot = lambda kind: F.struct(F.lit(kind).alias("t"), low.alias("v"))
        number = F.regexp_like(bare, F.lit(r"^[-+$€£#]?\p{Nd}[\p{Nd}.,:/]*%?$"))
        unit = bare.isin(UNITS) & F.regexp_like(F.coalesce(before, F.lit("")), F.lit(r"\p{Nd}[.,]?$"))
        name = F.regexp_like(bare, F.lit(r"^\p{Lu}[\p{Ll}'’-]+$")) & F.regexp_like(F.coalesce(before, F.lit(".")), F.lit(r"[^.!?:;|>\"]$"))
        return F.when(number, slot("<num>")).when(unit, slot("<unit>")).when(name, slot("<name>")).otherwise(literal(low))

    def token(w: Column, i: Column) -> Column:
        # most words are lower-case letters and need one pattern only
        plain = F.regexp_like(w, F.lit(r"^\p{Ll}+$")) & ~w.isin(UNITS)
        return F.when(plain, literal(w)).otherwise(let(F.trim(w, F.lit(MARKS)), lambda bare: marked(w, i, bare)))

    return F.transform(words, token)


def canonical_tokens(text: Column) -> Column:
    """A struct of t (template tokens) and v (values in slots; null for a text without slots) of a text.

    Most texts have no digit and no capital inside a sentence, so nothing in
    them becomes a slot: one split gives their tokens.
    """
    marks = r"[.,;:!?\"'()\[\]{}]*"
    inner_capital = rf'[^.!?:;|>"\x20\x09-\x0D]{SPACE_CLASS}+{marks}\p{{Lu}}[\p{{Ll}}\'’-]'
    slotted = F.regexp_like(text, F.lit(r"\p{Nd}")) | F.regexp_like(text, F.lit(inner_capital))
    named = lambda t, v: F.struct(t.alias("t"), v.alias("v"))
    slow = let(let(words_of(text), template), lambda w: let(F.filter(w, lambda x: x["t"] != ""), lambda x: named(x["t"], x["v"])))
    tokens = F.array_remove(F.split(F.trim(F.lower(text), F.lit(MARKS)), f"{marks}{SPACE_CLASS}+{marks}"), "")
    return F.when(slotted, slow).otherwise(named(tokens, F.lit(None).cast("array<string>")))


def _windows(rows: DataFrame, key: str, text: Column, window: int) -> DataFrame:
    """key, _s (values in slots), _n, pos, h of every window; texts shorter than a window are one window.

    A window is a row of the tokens zipped with themselves shifted, so rows are
    hashed in generated code.
    """
    # a generator of one row, so that the tokens are worked out once and not for each window
    tokens = rows.select(key, F.explode(F.array(canonical_tokens(F.coalesce(text, F.lit(""))))).alias("_x"))
    return _hashed(tokens.select(key, F.col("_x.t").alias("_t"), F.col("_x.v").alias("_v")).where(F.size("_t") > 0), [key], window)


def _hashed(tokens: DataFrame, keys: list[str], window: int) -> DataFrame:
    """keys, _s (the window's values in slots; null for a text without slots), _n, pos, h of every window of rows with _t (tokens) and _v.

    Each window gets its own values only: none carries those of the whole text.
    """
    n = F.size("_t")
    shifted = [F.slice("_t", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(window)]
    values = F.when(F.col("_v").isNotNull(), F.transform("_v", lambda _, i: F.slice("_v", i + 1, window))).otherwise(F.array().cast("array<array<string>>"))
    each = tokens.select(*keys, n.alias("_n"), F.arrays_zip(*shifted, values.alias("s")).alias("_a")).select(*keys, "_n", F.posexplode("_a").alias("pos", "_z"))
    whole = F.col(f"_z.w{window - 1}").isNotNull() | ((F.col("pos") == 0) & (F.col("_n") < window))
    return each.where(whole).select(*keys, F.col("_z.s").alias("_s"), "_n", "pos", F.xxhash64(*[F.col(f"_z.w{k}") for k in range(window)]).alias("h"))


def _slots(window: int) -> Column:
    """Slot values of a window; literals are null."""
    return F.coalesce("_s", F.array_repeat(F.lit(None).cast("string"), F.least(F.lit(window), F.col("_n"))))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """item, pos, h, slots, n_windows of the benchmark's windows that have enough literal words."""
    every = _windows(benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("_text")), "item", F.col("_text"), window)
    slots = _slots(window)
    literals = F.size(F.filter(slots, lambda v: v.isNull()))
    kept = every.select("item", "pos", "h", slots.alias("slots")).where(literals >= F.least(F.lit(LEAST_LITERALS), F.size("slots")))
    # rows that share an id are one item: windows of all of them count
    kept = kept.groupBy("item", "pos", "h").agg(F.first("slots").alias("slots"))
    return kept.join(kept.groupBy("item").agg(F.count(F.lit(1)).alias("n_windows")), "item")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, share and reparameterised of every leak.

    Null and empty texts leak nothing. Rows with the same doc_id are one
    document; items with the same id are one item. Rows with a null id don't
    take part. ``reparameterised``: a slot differs from the item's. An item
    shorter than a window matches only texts that are this item and no more.
    """
    items = checkpoint(benchmark_windows(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col, window))
    items = items.withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"})
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"))
    found = _windows(own, "doc", F.col("_text"), window)
    slots = _slots(window)
    if items.count() <= broadcast_windows:
        # slot values are cut out for matches only
        matched = found.join(F.broadcast(items), "h").select("doc", "item", "n_windows", "pos", "item_pos", "item_slots", slots.alias("slots"))
    else:
        matched = found.select("doc", "pos", "h", slots.alias("slots")).join(items, "h")
    filled = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"].isNotNull() & x["d"].isNotNull())
    diagonal = matched.groupBy("doc", "item", (F.col("pos") - F.col("item_pos")).alias("_shift")).agg(
        F.max("n_windows").alias("n_windows"), F.collect_set("item_pos").alias("_at"), F.array_distinct(F.flatten(F.collect_set(filled))).alias("_slots")
    )
    pairs = F.size("_slots")
    one_to_one = (F.size(F.array_distinct(F.col("_slots.i"))) == pairs) & (F.size(F.array_distinct(F.col("_slots.d"))) == pairs)
    sound = diagonal.where(one_to_one).withColumn("_changed", F.exists("_slots", lambda x: x["i"] != x["d"]))
    whole = sound.groupBy("doc", "item").agg(
        F.max("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("_at")))).cast("long").alias("n_matched"), F.max("_changed").alias("reparameterised")
    )
    share = F.col("n_matched") / F.col("n_windows")
    return whole.where(share >= least_share).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_matched", share.alias("share"), "reparameterised")


# --- leaks beyond the template rule -------------------------------------------------------------------------

#: Words of a run that is a leak whatever share of the item it is.
RUN_WORDS = 13


def plain_word(text: Column) -> Column:
    """``text`` lower-cased, without punctuation and symbols."""
    return F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]+", "")


_TOKEN = "struct<place:int,t:string,v:string>"


def _item_streams(items: DataFrame) -> DataFrame:
    """item, kind, x (place: number of the word, t, v) of template tokens ('t') and, where they differ from those, plain words ('p')."""
    worded = items.select("item", words_of(F.coalesce("_text", F.lit(""))).alias("_w")).select("item", "_w", template(F.col("_w")).alias("_t"))
    shaped = F.transform("_t", lambda x, i: F.struct(i.alias("place"), x["t"].alias("t"), x["v"].alias("v")).cast(_TOKEN))
    plain = F.transform("_w", lambda w, i: F.struct(i.alias("place"), plain_word(w).alias("t"), F.lit(None).cast("string").alias("v")).cast(_TOKEN))
    both = worded.select("item", *[F.filter(c, lambda x: x["t"] != "").alias(k) for k, c in (("t", shaped), ("p", plain))])
    stream = lambda k: F.struct(F.lit(k).alias("kind"), F.col(k).alias("x"))
    each = F.when(F.col("t.t") == F.col("p.t"), F.array(stream("t"))).otherwise(F.array(stream("t"), stream("p")))
    return both.select("item", F.explode(each).alias("_s")).select("item", "_s.kind", "_s.x")


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, item_kind, item_pos, h, item_slots, rank (among the kind's windows), place, counts (towards the share) and n_windows."""
    n = F.size("x")
    shifted = [F.slice("x", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(window)]
    zipped = _item_streams(items).select("item", "kind", n.alias("_n"), F.arrays_zip(*shifted).alias("_a"))
    each = zipped.select("item", "kind", "_n", F.posexplode("_a").alias("pos", "_z"))
    each = each.where(F.col(f"_z.w{window - 1}").isNotNull() | ((F.col("pos") == 0) & (F.col("_n") < window) & (F.col("kind") == "t")))
    of = lambda c: [F.col(f"_z.w{k}.{c}") for k in range(window)]
    slots = F.slice(F.array(*of("v")), F.lit(1), F.least(F.lit(window), F.col("_n")))
    each = each.select("item", "kind", "pos", F.col("_z.w0.place").alias("place"), slots.alias("slots"), F.xxhash64(*of("t")).alias("h"))
    literals = F.size(F.filter("slots", lambda v: v.isNull()))
    kept = each.where((F.col("kind") == "p") | (literals >= F.least(F.lit(LEAST_LITERALS), F.size("slots"))))
    kept = kept.groupBy("item", "kind", "pos", "h").agg(F.first("slots").alias("slots"), F.min("place").alias("place"))
    template_window, of_item = F.col("kind") == "t", Window.partitionBy("item")
    kept = kept.withColumns({"rank": F.dense_rank().over(Window.partitionBy("item", "kind").orderBy("pos")), "_own": F.max(template_window).over(Window.partitionBy("item", "place")), "_templates": F.count_if(template_window).over(of_item), "_all": F.count(F.lit(1)).over(of_item)})
    n_windows = F.when(F.col("_templates") > 0, F.col("_templates")).otherwise(F.col("_all"))
    counts = (F.col("_templates") == 0) | F.col("_own")
    return kept.select("item", F.col("kind").alias("item_kind"), F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots"), "rank", "place", counts.alias("counts"), n_windows.alias("n_windows"))


def _doc_streams(docs: DataFrame) -> DataFrame:
    """doc, kind, _t, _v: a text's template tokens and, where they differ from those, its plain words."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    both = docs.select("doc", canonical_tokens(text).alias("_x"), F.array_remove(F.split(plain_word(text), SPACE_CLASS + "+"), "").alias("_p"))
    shaped = F.struct(F.lit("t").alias("kind"), F.col("_x.t").alias("t"), F.col("_x.v").alias("v"))
    plain = F.struct(F.lit("p").alias("kind"), F.col("_p").alias("t"), F.lit(None).cast("array<string>").alias("v"))
    each = F.when(F.col("_x.t") == F.col("_p"), F.array(shaped)).otherwise(F.array(shaped, plain))
    return both.select("doc", F.explode(each).alias("_s")).select("doc", "_s.kind", F.col("_s.t").alias("_t"), F.col("_s.v").alias("_v")).where(F.size("_t") > 0)


def _short_leaks(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc, item of items of fewer than ``window`` words that a text holds word for word, by windows of their own length."""
    words = lambda text: F.array_remove(F.split(plain_word(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), "")
    short = items.where(F.size(F.filter(template(words_of(F.coalesce("_text", F.lit("")))), lambda x: x["t"] != "")) < window)
    short = short.select("item", words(F.col("_text")).alias("_p")).where(F.size("_p").between(1, window - 1))
    short = checkpoint(short.select("item", F.size("_p").alias("size"), F.xxhash64("_p").alias("h")).distinct())
    sizes = [r["size"] for r in short.select("size").distinct().collect()]  # fewer than window
    if not sizes:
        return docs.select("doc", F.lit(None).cast(items.schema["item"].dataType).alias("item")).limit(0)

    def hashes(size: int) -> Column:
        at = F.when(F.size("_p") >= size, F.sequence(F.lit(1), F.size("_p") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct(F.lit(size).alias("size"), F.xxhash64(F.slice("_p", k, size)).alias("h")))

    tokens = docs.select("doc", words(F.col("_text")).alias("_p"))
    every = tokens.select("doc", F.explode(F.array_distinct(F.flatten(F.array(*[hashes(size) for size in sizes])))).alias("_x")).select("doc", "_x.size", "_x.h")
    return every.join(short, ["h", "size"]).select("doc", "item").distinct()


def _judged(matched: DataFrame, least_run: int) -> DataFrame:
    """doc, item, n_windows, _n_strict and _n_places (places that count by either rule), _run, _strict_changed and _changed.

    Matched windows are taken apart into a row for each of their slots, so each
    value is counted, compared and put back by sorting rows: the cost follows
    the windows, however many slots an item has. One exchange by document and
    item serves every step after repeated windows are gone.
    """
    line = ["doc", "item", "kind", "item_kind", "shift"]
    place = ["item_pos", "rank", "place", "counts", "pairs"]
    windows = matched.groupBy(*line, *place).agg(F.max("n_windows").alias("n_windows")).repartition("doc", "item")
    slots = windows.select("*", F.explode_outer("pairs").alias("_q")).select(*line, *place, "n_windows", F.col("_q.i").alias("_i"), F.col("_q.d").alias("_d"))
    # how often each value of the document meets each value of the item, and the one that most windows give
    of_value = Window.partitionBy(*line, "_i")
    slots = slots.withColumn("_n", F.count("_d").over(Window.partitionBy(*line, "_i", "_d")))
    slots = slots.withColumn("_best", F.max(F.struct("_n", (F.col("_i") == F.col("_d")).alias("same"), "_d")).over(of_value)["_d"])
    slots = slots.withColumn("_split", F.min("_d").over(of_value) != F.max("_d").over(of_value))
    meets = Window.partitionBy(*line, "_d")
    slots = slots.withColumn("_shared", F.min("_i").over(meets) != F.max("_i").over(meets))
    differs = F.coalesce(F.col("_i") != F.col("_d"), F.lit(False))
    each = slots.groupBy(*line, *place).agg(
        F.max("n_windows").alias("n_windows"), F.max(differs).alias("_differs"), F.max(F.coalesce(F.col("_d") != F.col("_best"), F.lit(False))).alias("_contradicts"),
        F.max(F.coalesce(F.col("_split") | F.col("_shared"), F.lit(False))).alias("_torn"),
    )
    kept = ~F.col("_differs") | ~F.col("_contradicts")
    on_line = Window.partitionBy(*line)
    sound = (F.col("kind") == "t") & (F.col("item_kind") == "t") & ~F.max("_torn").over(on_line)
    each = each.withColumns({"_kept": kept, "_sound": sound})
    # ranks in a row keep their distance from their number among the line's ranks
    island = F.col("rank") - F.dense_rank().over(Window.partitionBy(*line, "_kept").orderBy("rank"))
    each = each.withColumn("_island", island)
    runs = Window.partitionBy(*line, "_kept", "_island")
    each = each.withColumn("_run", F.col("_kept") & (F.max("rank").over(runs) - F.min("rank").over(runs) + 1 >= least_run))
    # at most as many places as the item has windows
    places = lambda when, c: F.size(F.collect_set(F.when(when, F.col(c)))).cast("long")
    return each.groupBy("doc", "item").agg(
        F.max("n_windows").alias("n_windows"), places(F.col("_sound"), "item_pos").alias("_n_strict"), places(F.col("_kept") & F.col("counts"), "place").alias("_n_places"),
        F.max("_run").alias("_run"), F.max(F.when(F.col("_sound"), F.col("_differs"))).alias("_strict_changed"), F.max(F.col("_kept") & F.col("_differs")).alias("_changed"),
    )


def all_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """What ``leaks`` finds, with the same figures, and the leaks that its rule passes over.

    * Plain words, lower-cased and without marks, are matched as well as template
      tokens, so copies in other cases or without punctuation are found, and so
      are lists of numbers or names that are equal. Both count by place in the item.
    * Windows that contradict the values most others give an item's slots on
      their diagonal are dropped, not the diagonal; windows equal to the item's
      always stay. Two slots may meet the same value.
    * ``run_words`` words in a row on one diagonal are a leak whatever their share.
    * An item shorter than a window is found word for word inside any text.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("_text"))
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"))
    wanted = checkpoint(_item_windows(items, window))
    found = _hashed(_doc_streams(own), ["doc", "kind"], window)
    slots = _slots(window)
    own_columns = ["doc", "kind", "item", "item_kind", "n_windows", "pos", "item_pos", "rank", "place", "counts", "item_slots"]
    if wanted.count() <= broadcast_windows:
        matched = found.join(F.broadcast(wanted), "h").select(*own_columns, slots.alias("slots"))
    else:
        matched = found.select("doc", "kind", "pos", "h", slots.alias("slots")).join(wanted, "h").select(*own_columns, "slots")
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"].isNotNull() & x["d"].isNotNull())
    whole = _judged(matched.select("doc", "item", "kind", "item_kind", (F.col("pos") - F.col("item_pos")).alias("shift"), "n_windows", "item_pos", "rank", "place", "counts", pairs.alias("pairs")), run_words - window + 1)
    strict = F.col("_n_strict") / F.col("n_windows") >= least_share
    whole = whole.where(strict | (F.col("_n_places") / F.col("n_windows") >= least_share) | F.col("_run"))
    n = F.when(strict, F.col("_n_strict")).otherwise(F.col("_n_places"))
    out = whole.select("doc", "item", "n_windows", n.alias("n_matched"), (n / F.col("n_windows")).alias("share"), F.when(strict, F.col("_strict_changed")).otherwise(F.col("_changed")).alias("reparameterised"))
    short = _short_leaks(own, items, window).select("doc", "item", F.lit(1).cast("long").alias("n_windows"), F.lit(1).cast("long").alias("n_matched"), F.lit(1.0).alias("share"), F.lit(False).alias("reparameterised"))
    out = checkpoint(out)
    out = out.unionByName(short.join(out.select("doc", "item"), ["doc", "item"], "left_anti"))
    return out.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def oracle_sql(window: int = WINDOW, least_share: float = LEAST_SHARE) -> str:
    """The registered query in DuckDB SQL, token by token; for tables whose ids are unique."""
    units = ", ".join("'" + u + "'" for u in UNITS)
    marks = "'" + MARKS.strip().replace("'", "''") + "'"
    space = r"[\x20\x09-\x0D]"
    ahead = ", ".join(f"lead({c}, {k}) OVER o AS {c}{k}" for k in range(1, window) for c in "tv")
    key = " || chr(31) || ".join(["t", *(f"coalesce(t{k}, chr(30))" for k in range(1, window))])
    values = "[v, " + ", ".join(f"v{k}" for k in range(1, window)) + "]"
    literals = " + ".join(["(v IS NULL AND t IS NOT NULL)::INT", *(f"(v{k} IS NULL AND t{k} IS NOT NULL)::INT" for k in range(1, window))])
    return f"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
ws AS (SELECT side, id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT side, id, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS l FROM src)),
pv AS (SELECT *, lag(w) OVER (PARTITION BY side, id ORDER BY i) AS b, trim(w, {marks}) AS bare FROM ws),
kd AS (SELECT side, id, i, lower(bare) AS low, CASE WHEN regexp_full_match(bare, '[-+$€£#]?\\p{{Nd}}[\\p{{Nd}}.,:/]*%?') THEN '<num>'
         WHEN bare IN ({units}) AND regexp_matches(coalesce(b, ''), '\\p{{Nd}}[.,]?$') THEN '<unit>'
         WHEN regexp_full_match(bare, '\\p{{Lu}}[\\p{{Ll}}''’-]+') AND regexp_matches(coalesce(b, '.'), '[^.!?:;|>"]$') THEN '<name>' END AS kind FROM pv WHERE bare <> ''),
tk AS (SELECT side, id, row_number() OVER (PARTITION BY side, id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY side, id) AS n, coalesce(kind, low) AS t, CASE WHEN kind IS NOT NULL THEN low END AS v FROM kd),
ah AS (SELECT *, {ahead} FROM tk WINDOW o AS (PARTITION BY side, id ORDER BY pos)),
wi AS (SELECT side, id, pos, {key} AS k, {values} AS vs, {literals} AS lits FROM ah WHERE t{window - 1} IS NOT NULL OR (pos = 0 AND n < {window})),
it AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_windows FROM (SELECT wi.*, least({window}, tk.n) AS size FROM wi JOIN tk ON wi.side = tk.side AND wi.id = tk.id AND wi.pos = tk.pos WHERE wi.side = 'i') WHERE lits >= least({LEAST_LITERALS}, size)),
ma AS (SELECT d.id AS doc, i.id AS item, n_windows, d.pos - i.pos AS shift, i.pos AS at_, i.vs AS iv, d.vs AS dv FROM wi d JOIN it i ON d.k = i.k WHERE d.side = 'd'),
sl AS (SELECT doc, item, shift, unnest(iv) AS a, unnest(dv) AS b FROM ma),
sx AS (SELECT doc, item, shift, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, count(DISTINCT (a, b)) AS np, bool_or(a <> b) AS changed FROM sl WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc, item, shift),
ok AS (SELECT ma.*, coalesce(changed, false) AS changed FROM ma LEFT JOIN sx USING (doc, item, shift) WHERE np IS NULL OR (na = np AND nb = np)),
wh AS (SELECT doc, item, max(n_windows) AS n_windows, count(DISTINCT at_) AS n_matched, bool_or(changed) AS reparameterised FROM ok GROUP BY doc, item)
SELECT doc AS doc_id, item AS item_id, n_windows, n_matched, n_matched / n_windows AS share, reparameterised FROM wh WHERE n_matched / n_windows >= {least_share}
"""
