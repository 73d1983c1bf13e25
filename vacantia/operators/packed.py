"""Several values packed in one field, to one value per row with its position.

Each text is masked to a delimiter skeleton: the set of delimiter marks that stand outside
quotes and escapes. Splitting rules are resolved per distinct skeleton and broadcast (at most
2^len(MARKS) skeletons exist, whatever the data), then applied by positional extraction.

Conjunctions stay ambiguous in a skeleton ("Ireland and Estonia", "health and safety"): the
last item of a comma list, or a sole item, is split at a conjunction unless the corpus shows
the whole as one value where its bounds are certain (quoted, escaped, bracketed, on a line of
its own, between other delimiters, or before the last place of a list).

Defined results: null and blank texts and empty items give no row; repeated values are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import settle

CONJUNCTION = r"(?:and|or|&|und|oder)"
_QUOTED = r'"(?:[^"\\]|""|\\.)*"'
#: Marks of a skeleton, in this order. q a quoted part, e an escape, & a conjunction, [ brackets around the whole.
MARKS = ("[", "\n", ";", "|", "•", "·", "/", ",", "&", "q", "e")


def skeleton(text: Column) -> Column:
    """The marks that occur outside quotes and escapes, each once, in the order of MARKS."""
    masked = F.regexp_replace(text, r"[qe]", "a")
    masked = F.regexp_replace(masked, rf"(?<![^\s,;|•·\[]){_QUOTED}", "q")
    masked = F.regexp_replace(masked, r"\\.", "e")
    masked = F.regexp_replace(masked, r"\r\n?|\n", "\n")
    marks = [
        F.when(masked.rlike(r"^\[.*\]$"), "["),
        *[F.when(masked.contains(m), m) for m in ("\n", ";", "|", "•", "·")],
        F.when(masked.rlike(r"\s/\s"), "/"),
        F.when(masked.contains(","), ","),
        F.when(masked.rlike(rf"(?i)(?:^|\s){CONJUNCTION}\s"), "&"),
        F.when(masked.contains("q"), "q"),
        F.when(masked.contains("e"), "e"),
    ]
    return F.array_join(F.array_compact(F.array(*marks)), "")


def rules(skeletons: DataFrame) -> DataFrame:
    """(skeleton) to (skeleton, mode, conj): how texts of that skeleton are split."""
    k = F.col("skeleton")
    other = k.rlike(r"[;|•·/]")
    mode = F.when(k.startswith("["), "json").when(k.contains("\n"), "lines")
    mode = mode.when(k.contains("/") & ~k.rlike(r"[;|•·,]"), "slash").when(k.rlike(r"[;|•·,/]"), "marks").otherwise("one")
    return skeletons.select("skeleton", mode.alias("mode"), (k.contains("&") & ~other & ~k.contains("\n") & ~k.startswith("[")).alias("conj"))


def _items(text: Column, mode: Column) -> Column:
    """Raw items in order. A part that is quoted or escaped is never cut."""

    def cut_at(stop: str, ahead: str = "") -> Column:
        return F.regexp_extract_all(text, F.lit(rf"(?:(?<![^\s,;|•·/]){_QUOTED}|\\.|{ahead}[^{stop}])+"), F.lit(0))

    inner = F.regexp_replace(text, r"^\[|\]$", "")
    plain = F.regexp_extract_all(inner, F.lit(rf"(?:(?<![^\s,]){_QUOTED}|\\.|[^,])+"), F.lit(0))
    as_json = F.filter(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), lambda x: x.isNotNull())
    return (
        F.when(mode == "json", F.coalesce(F.transform(as_json, lambda x: F.concat(F.lit("\u0001"), x)), plain))
        .when(mode == "lines", F.split(text, r"\r\n?|\n"))
        .when(mode == "slash", F.split(text, r"\s/\s(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
        .when(mode == "marks", F.transform(cut_at(";|•·,", r"(?!\s/\s)"), lambda x: F.regexp_replace(x, r"^/\s+", "")))
        .otherwise(F.array(text))
    )


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", "")


def _clean(raw: Column) -> Column:
    """One item as (val, sure): outer blanks, list marks, quotes and escapes removed; sure where its bounds are marked."""
    bare = trimmed(raw)
    bare = trimmed(F.regexp_replace(bare, r"^(?:[-*•·‣▪]|\d{1,2}[.)])\s+", ""))
    is_json, quoted = raw.startswith("\u0001"), bare.rlike(rf"^{_QUOTED}$")
    unquoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r'^"|"$', ""), '""', '"'), r"\\(.)", "$1")
    unescaped = F.regexp_replace(bare, r"\\(.)", "$1")
    val = F.when(is_json, trimmed(F.substring(raw, 2, 1 << 30))).when(quoted, trimmed(unquoted)).otherwise(unescaped)
    return F.struct(val.alias("val"), (is_json | quoted | bare.contains("\\")).alias("sure"))


def unpack(fields: DataFrame) -> DataFrame:
    """(src, record_id, field_name, text) to (src, record_id, field_name, pos, val); extra columns are left out."""
    key = ["src", "record_id", "field_name"]
    rows = fields.select(*key, trimmed(F.col("text")).alias("text")).filter("text <> ''").withColumn("skeleton", skeleton(F.col("text")))
    rules_of = rules(rows.select("skeleton").distinct())
    ruled = rows.join(F.broadcast(rules_of), "skeleton")  # bounded by the number of sets of marks
    items = F.filter(F.transform(_items(F.col("text"), F.col("mode")), _clean), lambda x: x["val"] != "")
    split = ruled.select(*key, "conj", items.alias("items")).select(*key, "conj", F.size("items").alias("n"), F.posexplode("items").alias("at", "item"))
    open_item = F.col("conj") & (F.col("at") == F.col("n") - 1) & ~F.col("item.sure") & F.col("item.val").rlike(rf"(?i)(?:^|\s){CONJUNCTION}\s")
    # read by the lexicon, by the open items and by the result
    flat = settle(split.select(*key, (F.col("at") + 1).cast("long").alias("pos"), F.col("item.val").alias("val"), open_item.alias("open")), "packed")

    closed = flat.filter("not open").select(*key, "pos", "val")
    resolved = resolve_conjunctions(flat.filter("open").groupBy("val").agg(F.count(F.lit(1)).alias("n")), flat.filter("not open").groupBy("val").agg(F.count(F.lit(1)).alias("n")))
    opened = flat.filter("open").join(resolved, "val").select(*key, "pos", F.posexplode("parts").alias("i", "val"))
    return closed.unionByName(opened.select(*key, (F.col("pos") + F.col("i")).cast("long").alias("pos"), "val"))


def resolve_conjunctions(open_values: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distinct open values to their parts. atoms: distinct values whose bounds are certain."""
    body = F.regexp_replace("val", rf"(?i)^{CONJUNCTION}\s+", "")
    link = rf"(?i)\s+{CONJUNCTION}\s+"
    # one marked string of words and links in turn
    turns = F.split(F.regexp_replace(body, rf"(?i)\s+({CONJUNCTION})\s+", "\u0001$1\u0001"), "\u0001")
    # a span longer than every known value cannot be one: its pieces bound the spans, whatever the data
    longest = atoms.agg(F.coalesce(F.max(F.size(F.split("val", link))), F.lit(1)).alias("n")).first()["n"]
    words = open_values.select("val", body.alias("body"), F.split(body, link, -1).alias("words"), turns.alias("turns"), (F.col("val") != body).alias("led"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 1),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.size("words") - i, F.lit(longest))),
                lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice("turns", i * 2 + 1, n * 2 - 1), " ").alias("span")),
            ),
        )
    )
    known = words.select("val", F.explode(spans).alias("s")).select("val", "s.*").join(atoms.select(F.col("val").alias("span")), "span", "left_semi")
    known = known.groupBy("val").agg(F.collect_set(F.struct("i", "n")).alias("known"))
    return words.join(known, "val", "left").select("val", _parts(F.coalesce("known", F.array().cast("array<struct<i:int,n:int>>"))).alias("parts"))


def _parts(known: Column) -> Column:
    """Longest known span at each place, else one word; nothing known at all leaves "and" uncut, as the likelier reading."""
    size = F.size("words")

    def step(acc: Column, i: Column) -> Column:
        best = F.coalesce(F.array_max(F.transform(F.filter(known, lambda k: k["i"] == i), lambda k: k["n"])), F.lit(1))
        part = F.array_join(F.slice("turns", i * 2 + 1, best * 2 - 1), " ")
        return F.when(i < acc["next"], acc).otherwise(F.struct((i + best).alias("next"), F.concat(acc["out"], F.array(part)).alias("out")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
    greedy = F.aggregate(F.sequence(F.lit(0), size - 1), start, step)["out"]
    only_and = ~F.exists(F.col("turns"), lambda t: F.lower(t).isin("or", "&", "oder"))
    return F.when((F.size(known) == 0) & only_and & ~F.col("led"), F.array("body")).otherwise(F.filter(greedy, lambda x: x != ""))
