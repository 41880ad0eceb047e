"""Line dedup as a segment-partition edit join, in DataFrame operations only.

A line goes if a line that starts earlier in the corpus (smaller doc_id, then earlier in the document) differs
from it by at most ``max_edits`` edits; lines are judged on the input.  Lines under ``min_chars`` characters have no
edit matches.  With ``short_repeats`` those that aren't blank go if they are equal to an earlier one; else they stay.

1. Equal lines are one: a line is known by two 64-bit hashes and the place of its first occurrence.
2. A line of length l is cut into ``max_edits + 1`` segments.  Of a line within ``max_edits`` edits at least one
   segment occurs unchanged in the other, at one of a few places that follow from the two lengths.  So every
   line is indexed under its own segments, and probes the indexes of its length and of the shorter ones with
   the substrings that can match.
3. Lines that share an index key are candidates.  Under a key with few lines all pairs are; under a crowded one
   (``max_edits`` 1) the lines are keyed once more by themselves with one character left out, which brings
   together just those at most one edit apart, and every line is paired with the earliest.  Only whether an
   earlier line exists matters, so no pair of a group is needed beyond that.
4. Candidates are verified with Hyyro's banded bit-parallel edit distance: the differences of a column of the
   matrix, as far as the band goes, are the bits of two numbers.
5. Which lines of a document stay comes back as bits, and the text is joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

MAX_EDITS = 1
MIN_CHARS = 20
#: Lines under one key of which all pairs are candidates; beyond it see 3.
CROWD = 32
#: Slots of the hashed semi-join that fetches candidate lines: the bound of what is broadcast.
SLOTS = 1 << 18
#: Lines to a number of kept bits.
WORD = 60


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(first character, length) of segment i of a line: even parts, the last ones longer by one."""
    base = F.floor(length / parts).cast("int")
    first_long = parts - length % parts
    return base * i + F.greatest(F.lit(0), F.lit(i) - first_long) + 1, base + (F.lit(i) >= first_long).cast("int")


def key(length: Column, i: int, text: Column) -> Column:
    return F.xxhash64(length, F.lit(i), text)


def keys(line: Column, length: Column, max_edits: int) -> list[tuple[bool, int, Column]]:
    """(indexed, segment, key) of every key of a line; a key that doesn't apply is null."""
    parts, out = max_edits + 1, []
    for i in range(parts):
        begin, size = segment(length, i, parts)
        out.append((True, i, key(length, i, F.substring(line, begin, size))))
    for shorter in range(max_edits + 1):
        other = length - shorter
        for i in range(parts):
            begin, size = segment(other, i, parts)
            for shift in range(max(-i, shorter - (max_edits - i)), min(i, shorter + (max_edits - i)) + 1):
                if shorter == 0 and shift == 0:
                    continue  # that is the index key itself
                at = begin + shift
                fits = (other > 0) & (at >= 1) & (at + size - 1 <= length)
                out.append((False, i, F.when(fits, key(other, i, F.substring(line, at, size)))))
    return out


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """The rows of ``pairs`` whose texts ``a`` (longer than ``edits``) and ``b`` are at most so many edits apart.

    Bit j of the band stands for the character of ``a`` that lies j - edits - 1 after the column's place, so the
    band moves down the diagonal from column to column.  The distance is followed along the band's lower edge until
    that reaches the end of ``a``, and along the last row from there.
    """
    width = 2 * edits + 2
    ones, top = (1 << width) - 1, 1 << (width - 1)
    begin = ones ^ ((1 << (width - edits - 1)) - 1)
    at = [f"(i + {j - edits - 1})" for j in range(width)]
    match = " + ".join(f"if({x} >= 1 and {x} <= w.m and try_element_at(w.p, {x}) <=> try_element_at(w.q, i), {1 << j}L, 0L)" for j, x in enumerate(at))
    edge = f"shiftright({top}L, greatest(0, i - (w.m - {edits})))"
    step = f"""if(i <= w.m - {edits}, if((y.d0 & {top}L) = 0L, 1L, 0L),
                  if((z.hp & {edge}) <> 0L, 1L, 0L) - if((z.hn & {edge}) <> 0L, 1L, 0L))"""
    # an array of one element that is transformed gives a name to an intermediate value
    # (a column of its own would be put in wherever it is used, and the line split again for each character)
    distance = f"""transform(array(named_struct('p', split({a}, ''), 'q', split({b}, ''), 'm', length({a}))), w ->
      aggregate(sequence(1, length({b})), named_struct('vp', {begin}L, 'vn', 0L, 'dist', cast({edits} as bigint)),
      (s, i) -> transform(array(named_struct('eq', {match})), x ->
        transform(array(named_struct('d0', ((((x.eq & s.vp) + s.vp) ^ s.vp) | x.eq | s.vn) & {ones}L)), y ->
          transform(array(named_struct('hp', (s.vn | ~(y.d0 | s.vp)) & {ones}L, 'hn', y.d0 & s.vp)), z ->
            named_struct('vp', (z.hn | ~(shiftright(y.d0, 1) | z.hp)) & {ones}L, 'vn', shiftright(y.d0, 1) & z.hp, 'dist', s.dist + {step})
          )[0])[0])[0],
      s -> s.dist))[0]"""
    return pairs.where(f"abs(length({a}) - length({b})) <= {edits} and length({a}) > {edits} and length({b}) > 0 and {distance} <= {edits}")


PLACE = ["d", "t", "pos"]


def place(alias: str) -> Column:
    return F.struct(*(F.col(f"{alias}.{c}") for c in PLACE))


def exploded(docs: DataFrame) -> DataFrame:
    """d, t, pos, line of each line."""
    return docs.select("d", "t", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def distinct_lines(docs: DataFrame, max_edits: int, min_chars: int, least: int) -> DataFrame:
    """The place of the first occurrence of each line of ``least`` characters, with its keys (null for a line under ``min_chars``)."""
    lines = exploded(docs).where(F.length(F.trim("line")) >= least).withColumn("length", F.length("line"))
    made = keys(F.col("line"), F.col("length"), max_edits)
    if least < min_chars:
        made = [(own, i, F.when(F.length(F.trim("line")) >= min_chars, k)) for own, i, k in made]
    rows = lines.select(
        F.xxhash64("line").alias("h"),
        F.xxhash64(F.lit("line"), "line").alias("g"),
        F.struct(*PLACE).alias("place"),
        *(k.alias(f"k{n}") for n, (_, _, k) in enumerate(made)),
    )
    once = rows.groupBy("h", "g").agg(F.min("place").alias("place"), *(F.min(f"k{n}").alias(f"k{n}") for n in range(len(made))))
    return once.select("place.*", *(f"k{n}" for n in range(len(made))))


def candidates(docs: DataFrame, first: DataFrame, max_edits: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of places, the texts of all lines in them)."""
    shape = [(own, i) for own, i, _ in keys(F.lit(""), F.lit(0), max_edits)]
    rows = first.select(*PLACE, F.explode(F.array(*(F.struct(F.col(f"k{n}").alias("key"), F.lit(own).alias("own"), F.lit(i).alias("segment")) for n, (own, i) in enumerate(shape)))).alias("k")).select(*PLACE, "k.*").where("key is not null")
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("indexed")).where("n > 1 and indexed").select("key", "n"))
    member = stored(rows.join(shared, "key"))

    # only documents whose slot holds a candidate are opened; the slots are few whatever the corpus
    slot = F.pmod(F.xxhash64("d", "t"), F.lit(SLOTS))
    slots = member.select(slot.alias("slot")).distinct()
    wanted = member.select(*PLACE).distinct()
    texts = stored(exploded(docs.join(F.broadcast(slots), slot == F.col("slot"), "left_semi")).join(wanted, PLACE).distinct())

    few = member if max_edits != 1 else member.where(F.col("n") <= crowd)
    a, b = few.where("own").alias("a"), few.alias("b")
    plain = a.join(b, (F.col("a.key") == F.col("b.key")) & (~F.col("b.own") | (place("a") < place("b")))).select(place("a").alias("a"), place("b").alias("b"))
    if max_edits != 1:
        return plain.distinct(), texts

    crowded = member.where(F.col("n") > crowd).join(texts, PLACE).withColumn("length", F.length("line"))
    half = F.floor((F.col("length") - F.when(F.col("own"), 0).otherwise(1)) / 2).cast("int")
    # the part that is not the shared segment: one of its characters is left out
    low = F.when(F.col("segment") == 0, half + 1).otherwise(F.lit(1))
    high = F.when(F.col("segment") == 0, F.col("length")).when(F.col("own"), half).otherwise(half + 1)

    def left_out(i: Column) -> Column:
        return F.concat(F.substring("line", F.lit(1), i - 1), F.substring("line", i + 1, F.col("length")))

    replaced = F.transform(F.sequence(low, high), lambda i: F.struct(F.xxhash64("key", F.lit("replaced"), i, left_out(i)).alias("v"), F.lit(0).alias("role")))
    longer = F.transform(F.sequence(low, high), lambda i: F.struct(F.xxhash64("key", F.lit("longer"), left_out(i)).alias("v"), F.lit(2).alias("role")))
    itself = F.array(F.struct(F.xxhash64("key", F.lit("longer"), "line").alias("v"), F.lit(1).alias("role")))
    variants = stored(crowded.select(F.struct(*PLACE).alias("a"), F.explode(F.when(F.col("own"), F.concat(replaced, itself)).otherwise(longer)).alias("x")).select("a", "x.*"))
    groups = variants.groupBy("v").agg(*(F.min(F.when(F.col("role") == r, F.col("a"))).alias(f"r{r}") for r in range(3)), F.count("*").alias("n")).where("n > 1").drop("n")
    partner = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    starred = variants.join(groups, "v").select("a", partner.alias("b")).where("b is not null and a <> b")
    return plain.unionByName(starred).distinct(), texts


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD, short_repeats: bool = False) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and n_lines and n_removed; all other columns are kept.

    A null text stays null and an empty one empty (both one line).  Rows with the same id and text are one document
    given twice and get the same result; with the same id and other texts they are ordered by a hash of the text; a
    null id comes before all others.  Columns of ``docs`` named n_lines or n_removed are replaced.
    """
    if not 1 <= max_edits <= 8 or min_chars <= max_edits:
        raise ValueError("max_edits is 1 to 8 and min_chars more than that")
    keyed = docs.drop("n_lines", "n_removed").withColumns({"__d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "__t": F.xxhash64(text)})
    base = keyed.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.col(text).alias("text"))
    least = 1 if short_repeats else min_chars
    first = stored(distinct_lines(base, max_edits, min_chars, least))
    pairs, texts = candidates(base, first, max_edits, crowd)
    named = pairs.select("a", "b").join(texts.select(F.struct(*PLACE).alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.struct(*PLACE).alias("b"), F.col("line").alias("line_b")), "b")
    later = stored(within(named, "line_a", "line_b", max_edits).select(F.greatest("a", "b").alias("p")).distinct().select("p.*"))

    def bits(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("d", "t", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias(name))

    stays = bits(first, "first").join(bits(later, "later"), ["d", "t", "word"], "left").select("d", "t", "word", F.col("first").bitwiseAND(F.bitwise_not(F.coalesce("later", F.lit(0).cast("long")))).alias("bits"))
    by_doc = stays.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__bits"))
    joined = keyed.join(by_doc, ["__d", "__t"], "left").withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    kept = F.filter("__lines", lambda x, i: (F.length(F.trim(x)) < least) | (F.getbit(F.coalesce(F.try_element_at("__bits", F.floor(i / WORD).cast("int")), F.lit(0).cast("long")), i % WORD) == 1))
    out = joined.withColumn("__kept", kept)
    values = {text: F.when(F.col(text).isNotNull(), F.array_join("__kept", "\n")), "n_lines": F.size("__lines").cast("long"), "n_removed": (F.size("__lines") - F.size("__kept")).cast("long")}
    return out.select(*(values[c].alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")), values["n_lines"].alias("n_lines"), values["n_removed"].alias("n_removed"))
