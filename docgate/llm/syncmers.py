"""Document fingerprints by closed syncmers, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate.llm.common import numbered, stage

#: Units of a k-mer and of its inner substrings; of all k-mers about 2 in SIZE - INNER + 1 are closed.
SIZE, INNER = 6, 2
#: Characters of a text that are worked on at a time, and some words more.
WINDOW = 65_536
#: Characters of scripts that write no blanks: Thai, kana, ideographs.
_ALONE = r"฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{3FFFF}"
#: A unit: one such character, or up to 16 others.
UNIT = rf"[!-~]{{1,16}}+|[{_ALONE}]|[^\s{_ALONE}]{{1,16}}+"
#: Characters before an edit among which a place to begin anew is looked for.
_NEAR = 400


def _bound(value: Column, use) -> Column:
    """use(value), where value is computed once: as the only element of an array that is transformed."""
    return F.transform(F.array(value), use)[0]


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _closed(units: Column, size: int, inner: int, taken) -> Column:
    """taken(place, hash) of the k-mers whose least inner substring is the first or the last one."""
    width = size - inner + 1
    covering = sorted({*range(0, width, inner), width - 1})

    def of(hashes: Column) -> Column:
        at = lambda i, j: F.get(hashes, i + j)

        def edge(i: Column) -> Column:
            inside = [at(i, j) for j in range(1, width - 1)]
            return F.least(at(i, 0), at(i, width - 1)) <= (F.least(*inside) if inside[1:] else inside[0])

        places = F.when(F.size(units) >= size, F.sequence(F.lit(0), F.size(units) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(places, edge), lambda i: taken(i, F.hash(*[at(i, j) for j in covering])))

    return _bound(F.transform(units, lambda x, i: F.xxhash64(x, *[F.get(units, i + j) for j in range(1, inner)])), of)


def _pieces(text: Column, size: int) -> Column:
    """The windows of a text, each of `size` words at least but for the last; one of a single window, as most are, isn't cut."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{WINDOW}}}\S*(?:\s+\S+){{0,{size}}}"), F.lit(0))
    return F.when(F.char_length(text) <= WINDOW, F.array(text)).otherwise(cut)


def _longer(pieces: Column, i: Column, size: int) -> Column:
    """A window and the first units of the next one, so that each k-mer is in the window that it begins in."""
    return F.concat(pieces[i], F.regexp_extract(F.coalesce(F.get(pieces, i + 1), F.lit("")), rf"^(?:\s*(?:{UNIT})){{1,{size - 1}}}", 0))


def _whole(text: Column) -> Column:
    """The hash of all units of a text, null if it has none."""
    return F.when(F.regexp_like(text, F.lit(r"\S")), F.hash(_units(text)))


def anchors(text: Column, size: int = SIZE, inner: int = INNER) -> Column:
    """The closed syncmers of a text: array<struct<place int, hash int>>, in order; place counts units from 0.

    Units are words of up to 16 characters (longer ones are cut; Chinese, Japanese and Thai by the character), a k-mer is `size`
    units, its inner substrings `inner` units each, ordered by their hashes. A k-mer is taken if its least inner substring is at an
    edge, which depends on its own units alone: a passage has the same anchors wherever it stands, and of any size - inner + 1
    k-mers in a row one is taken. A text without any, as one of few units, has its whole sequence as the only anchor; one without a unit
    (null, empty, blank) has none. Equal texts have equal anchors. Long texts are worked on in windows of WINDOW characters that
    overlap by size - 1 units, with the same result."""
    if size - inner < 2 or inner < 1:
        raise ValueError("a k-mer has three inner substrings at least")

    def whole(pieces: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            pair = lambda place, h: F.struct(place.alias("place"), h.alias("hash"))
            own = _bound(_units(_longer(pieces, i, size)), lambda units: _closed(units, size, inner, pair))
            return F.struct(F.when(F.size(pieces) > 1, F.size(_units(p))).otherwise(0).alias("n"), own.alias("found"))

        def placed(parts: Column) -> Column:
            def moved(x: Column, i: Column) -> Column:
                start = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, y: n + y["n"])
                return _bound(start, lambda s: F.transform(x["found"], lambda a: F.struct((a["place"] + s).alias("place"), a["hash"].alias("hash"))))

            return F.flatten(F.transform(parts, moved))

        return _bound(F.transform(pieces, piece), placed)

    said = F.coalesce(text, F.lit(""))
    alone = F.when(_whole(said).isNotNull(), F.array(F.struct(F.lit(0).alias("place"), _whole(said).alias("hash"))))
    none = F.array().cast("array<struct<place:int,hash:int>>")
    return _bound(_bound(_pieces(said, size), whole), lambda found: F.when(F.size(found) > 0, found).otherwise(F.coalesce(alone, none)))


def closed(text: Column, size: int = SIZE, inner: int = INNER) -> Column:
    """The hashes of anchors() without places: array<int>, and empty for a text that has no closed syncmer. text isn't null."""

    def whole(pieces: Column) -> Column:
        piece = lambda p, i: _bound(_units(_longer(pieces, i, size)), lambda units: _closed(units, size, inner, lambda _, h: h))
        return F.flatten(F.transform(pieces, piece))

    return _bound(_pieces(text, size), whole)


def or_whole(hashes: Column, text: Column) -> Column:
    """The hashes of closed(), or that of the whole sequence where there are none: those of anchors()."""
    return F.when(F.size(hashes) > 0, hashes).otherwise(F.filter(F.array(_whole(text)), lambda x: x.isNotNull()))


def closed_after(text: Column, hashes: Column, kept: Column, edited: Column, size: int = SIZE, inner: int = INNER) -> Column:
    """closed(edited), of a text that begins with the first `kept` characters of `text`, whose closed syncmers are `hashes`.

    Since an anchor depends on its own units alone, those that begin before the last `size` words of what is kept stay. What is behind is
    taken from both texts, to leave out the one and add the other. Where so many words aren't found near the edit, the whole edited text
    is looked at."""
    near = F.substring(text, F.greatest(kept - (_NEAR - 1), F.lit(1)), F.least(kept, F.lit(_NEAR)))
    start = F.char_length(F.regexp_extract(near, rf"(?:\s+\S+){{{size}}}\s*$", 0))

    def from_here(b: Column) -> Column:
        tail = lambda t: closed(F.substring(t, b + 1, F.lit(2**31 - 1)), size, inner)
        return F.concat(F.slice(hashes, F.lit(1), F.size(hashes) - F.size(tail(text))), tail(edited))

    return _bound(F.when(start > 0, kept - start).otherwise(0), from_here)


def fingerprint(hashes: Column) -> Column:
    """Hashes of anchors as one text: eight hex digits of each, in order."""
    digits = lambda x: F.substring(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32)) + (1 << 32)), 2, 8)
    return F.lower(F.array_join(F.transform(hashes, digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of hashes, the share of those, each once, that are in both: from 0 to 1. Two without any are alike."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / sizes)


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs (key, a, b: arrays of anchors) as key, shift, matched: by how many units the passage that two texts share is moved, and how
    many anchors say so.

    Anchors meet by key and hash, those alone that are once in each text; the shift of most anchors wins, the smallest of equal
    ones. Pairs without a common anchor give no row, nor do null arrays; rows of one key are one pair."""

    def side(name: str) -> DataFrame:
        each = pairs.select("key", F.explode(name).alias("x")).groupBy("key", F.col("x.hash").alias("hash"))
        return each.agg(F.min("x.place").alias(name), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")

    shifts = side("a").join(side("b"), ["key", "hash"]).groupBy("key", (F.col("b") - F.col("a")).alias("shift")).agg(F.count(F.lit(1)).alias("matched"))
    best = F.max_by(F.struct("shift", "matched"), F.struct(F.col("matched"), -F.col("shift")))
    return shifts.groupBy("key").agg(best.alias("best")).select("key", "best.*")


def edited(docs: DataFrame, share: int = 4) -> DataFrame:
    """doc_id, text, edited, hashes, edited_hashes, next_hashes: each document beside an edited text, whose last floor(n / share) characters
    are replaced by the first as many (or all) of the next document, and the hashes of their anchors.

    Documents stand by doc_id, null first, those of one doc_id by a hash of their texts; after the last comes the first, so a
    single one is its own next. Rows that repeat both are one document, each with the same result. Null texts are empty. Other columns
    don't matter; no rows give no rows.

    Places are found on identifiers and hashes alone. Texts move once, to their place's key, with their hashes; from there the beginning
    that the document before wants goes on to it. Both joins read the same shuffled rows."""
    said = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    light = said.groupBy("doc_id", "mark").agg(F.max(F.char_length("text")).alias("size"), F.count(F.lit(1)).alias("copies"), F.lit(0).alias("one"))
    light = stage(numbered(stage(light, "marks"), "one", "doc_id", "mark"), "order")
    repeated = light.filter("copies > 1").limit(1).count() > 0
    after = F.pmod(F.col("idx") + 1, F.col("n"))
    before = light.select(after.alias("idx"), F.col("doc_id").alias("to_id"), F.col("mark").alias("to_mark"), F.floor(F.col("size") / share).cast("int").alias("take"))
    wanted = stage(light.select("idx", F.col("doc_id").alias("from_id"), F.col("mark").alias("from_mark")).join(before, "idx").drop("idx"), "wanted")

    moved = said.withColumn("hashes", closed(F.col("text")))
    given = moved.join(wanted, moved["doc_id"].eqNullSafe(wanted["from_id"]) & (moved["mark"] == wanted["from_mark"]))
    given = given.select("to_id", "to_mark", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"), or_whole(F.col("hashes"), F.col("text")).alias("next_hashes"))
    if repeated:
        given = given.groupBy("to_id", "to_mark").agg(F.first("head").alias("head"), F.first("next_hashes").alias("next_hashes"))
    own = moved.join(given, moved["doc_id"].eqNullSafe(given["to_id"]) & (moved["mark"] == given["to_mark"]))
    text, size = F.col("text"), F.char_length("text")
    kept = (size - F.floor(size / share)).cast("int")
    own = own.select("doc_id", "text", F.col("hashes").alias("closed"), "next_hashes", kept.alias("kept"), F.concat(F.substring(text, F.lit(1), kept), F.col("head")).alias("edited"))
    changed = closed_after(text, F.col("closed"), F.col("kept"), F.col("edited"))
    return own.select(
        "doc_id",
        "text",
        "edited",
        or_whole(F.col("closed"), text).alias("hashes"),
        _bound(changed, lambda x: or_whole(x, F.col("edited"))).alias("edited_hashes"),
        "next_hashes",
    )
