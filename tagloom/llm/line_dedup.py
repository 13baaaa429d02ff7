"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are sets of character shingles: SHINGLE characters from each place on (a
shorter line is its own one shingle). A signature holds the least hash of each
of BINS classes of a line's shingles; two neighbouring classes make a band, and
lines that agree in a band meet in a bucket. Of those that meet, pairs that
agree in AGREE classes at least go on. Bounds from the sizes and parities of
their sets, which are exact, leave out those that can't link; the others'
Jaccard similarity is computed from the texts, and pairs of THRESHOLD or more
are united by distributed union-find.

Of a bucket of SMALL members at most all pairs are looked at. A larger one's most
frequent line is compared with the others first. Of larger buckets that still hold
several components then, those of MEDIUM members at most have their pairs of
different components listed; each line's first pair is verified before the others.
Lines of still larger ones are dealt out by two more classes that
they agree in: as AGREE classes agree, of which a band has two, each pair that is
left meets so, and no such bucket is looked at as a whole. One line of each deal is
compared with those of other components first; what is still apart then is
compared in full, behind the exact bounds.

Of each component (equal lines are one line) the first occurrence stays, by
doc_id and place. For a pair just at the threshold the chance to meet is 0.97;
it grows quickly beyond.

Cases: a null text stays null; a line without a word (blank) is not looked at
and stays, all others count, whatever their length; a text all of whose lines
go becomes empty; rows without doc_id stay as they are; repeated rows are
repeated lines of one document: their equal lines go by place only, so all
copies keep the same lines; an empty table gives no rows; further columns come
out as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, fresh, sieve
from .components import components

SHINGLE = 8
THRESHOLD = 0.8
#: Classes of hashes (a power of two); two make a band.
BINS = 8
#: Classes in which lines must agree to be compared.
AGREE = 4
#: Hashes that are looked at for a class, on average: the least ones, so that most shingles take no part in minima.
LEAST = 6
#: Bits of a hash that order it within its class.
BITS = 31
KEY = ("k", "c")
CLASSES = [f"m{j}" for j in range(BINS)]
#: Members of a bucket of which all pairs are looked at; of larger ones the hub with the others, and then what is left.
SMALL = 12
#: Members of a bucket of which the pairs that its hub left apart are listed at once; lines of larger ones are dealt out, as rows for each pair of classes.
MEDIUM = 256
#: Rounds in which a line of each deal is compared with the rest.
ROUNDS = 1
#: 64-bit words that hold the parities of a line's set.
WORDS = 16
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, place and line of each line that holds a word, with the line's name: 96 bits of hash."""
    texts = docs.where("doc_id is not null").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    # trimming looks at bytes, where a pattern would have the line decoded first
    return texts.where(F.ltrim("line", F.lit(BLANKS)) != "").select("doc_id", "at", "line", F.xxhash64("line").alias("k"), F.hash("line").alias("c"))


def signatures(lines: DataFrame) -> DataFrame:
    """Of each different line k, c, how often it occurs and the least hash of each class (null: none).

    Shingles are rows here, so that hashing and minima are compiled code, and
    are summed up before anything is shuffled.
    """
    whole = lines.select("k", "c", F.encode("line", "UTF-32").alias("b"))
    sized_ = whole.withColumn("last", F.greatest(F.lit(1), F.octet_length("b") - (4 * SHINGLE - 1)))
    each = sized_.select("k", "c", "b", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4))).alias("i"))
    hashed = each.select("k", "c", "last", "i", F.xxhash64(F.col("b").substr(F.col("i"), F.lit(4 * SHINGLE))).alias("h"))
    most = (F.lit(float(1 << BITS)) * F.least(F.lit(1.0), F.lit(4.0 * LEAST * BINS) / F.col("last"))).cast("long")
    value = F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("v")
    some = hashed.select("k", "c", "i", most.alias("most"), F.col("h").bitwiseAND(F.lit(BINS - 1)).cast("int").alias("class"), value)
    some = some.where((F.col("v") <= F.col("most")) | (F.col("i") == 1))
    return some.groupBy(*KEY).agg(F.count_if(F.col("i") == 1).alias("times"), *(F.min(F.when(F.col("class") == j, F.col("v"))).alias(m) for j, m in enumerate(CLASSES)))


def _agreeing(a: str, b: str) -> Column:
    """In how many classes two signatures agree (columns named with these prefixes)."""
    return reduce(lambda x, y: x + y, (F.col(f"{a}{m}").eqNullSafe(F.col(f"{b}{m}")).cast("int") for m in CLASSES))


def _as(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{side}{c}") for c in rows.columns))


def _hashes(line: str) -> Column:
    """The hashes of the shingles of a line, in a column."""
    last = lambda b: F.greatest(F.lit(1), F.octet_length(b) - (4 * SHINGLE - 1))
    of = lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(4)), lambda i: F.xxhash64(b.substr(i, F.lit(4 * SHINGLE))))
    # the encoded line is a lambda's variable: a column would be copied whole for each shingle
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), of), 0)


def _parities(texts: DataFrame) -> DataFrame:
    """Of each line k, c the size n of its set, and for each class of shingles whether it holds an odd number of them, in WORDS words."""
    each = texts.select(*KEY, F.explode(F.array_distinct(_hashes("line"))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word")
    each = each.select(*KEY, word, bit.alias("bit")).groupBy(*KEY, "word").agg(F.count("*").alias("n"), F.bit_xor("bit").alias("p"))
    return each.groupBy(*KEY).agg(F.sum("n").alias("n"), *(F.bit_xor(F.when(F.col("word") == j, F.col("p")).otherwise(F.lit(0).cast("long"))).alias(f"p{j}") for j in range(WORDS)))


def _may_link() -> Column:
    """Whether sets of these sizes and parities may reach THRESHOLD: they differ in (1 - THRESHOLD) / (1 + THRESHOLD) of the elements of both at most, and in each class of another parity by one element at least. Exact: none is lost."""
    n, m = F.col("an"), F.col("bn")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"ap{j}").bitwiseXOR(F.col(f"bp{j}"))) for j in range(WORDS)))
    return (F.least(n, m) >= THRESHOLD * F.greatest(n, m) - 1e-6) & (differ * (1 + THRESHOLD) <= (1 - THRESHOLD) * (n + m) + 1e-6)


class _Verifier:
    """Texts of lines (k, c), fetched once, and the test of pairs (ak, ac, bk, bc) of them."""

    def __init__(self, lines: DataFrame, wanted: DataFrame, kept: Kept):
        self.kept, wanted = kept, kept.write(wanted.select(*KEY).distinct())
        texts = sieve(lines.select("k", "c", "line"), "k", wanted, "k")
        # an inner join: a semi-join would be pushed below the sieve
        self.texts = kept.write(texts.join(wanted.hint("merge"), list(KEY)).dropDuplicates(list(KEY)))
        kept.drop(wanted)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those that have THRESHOLD of their union in common, as structs a and b.

        Both texts of a pair meet in one row, so that its shingles are held for
        that row only, and no table of shingles of many pairs is looked up.
        """
        for x in "ab":
            pairs = pairs.join(_as(self.texts, x), [f"{x}k", f"{x}c"])
        names = [F.struct(F.col(f"{x}k").alias("k"), F.col(f"{x}c").alias("c")).alias(x) for x in "ab"]
        hashed = pairs.select(*names, _hashes("aline").alias("one"), _hashes("bline").alias("two"))
        alike = F.size(F.array_intersect("one", "two")) >= THRESHOLD * F.size(F.array_union("one", "two"))
        # written before they are filtered: a filter would move down and compute all of it twice
        return self.kept.write(hashed.select("a", "b", alike.alias("alike")))

    def drop(self) -> None:
        self.kept.drop(self.texts)


def _with_part(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines (k, c and more) with `part`, a hash of their component's name."""
    of = found.select(F.col("node.k").alias("k"), F.col("node.c").alias("c"), F.xxhash64("component.k", "component.c").alias("own"))
    return lines.join(of, list(KEY), "left").withColumn("part", F.coalesce("own", F.xxhash64("k", "c"))).drop("own")


def _code() -> Column:
    """What orders lines: those that occur more often come first, as copies with changes resemble their common original rather than each other. It tells lines apart as well."""
    often = F.least("times", F.lit((1 << 20) - 1))
    return F.shiftleft((F.lit((1 << 20) - 1) - often).cast("long"), 43).bitwiseOR(F.shiftrightunsigned("k", 21)).alias("code")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Lines, with their part, of buckets that hold several components besides their first line."""
    held = _with_part(members.where("code <> hub"), found)
    parted = held.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    return held.join(parted.hint("merge"), "bucket")


def _listed(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of codes, with their names, of lines of one bucket and different components that agree in AGREE classes."""
    rows = apart.select("bucket", "code", *KEY, "part", *CLASSES)
    one, two = _as(rows, "a"), _as(rows, "b")
    met = one.join(two, (F.col("abucket") == F.col("bbucket")) & (F.col("acode") < F.col("bcode")) & (F.col("apart") != F.col("bpart")) & (_agreeing("a", "b") >= AGREE))
    return met.select(F.col("acode").alias("a"), "ak", "ac", F.col("bcode").alias("b"), "bk", "bc").distinct()


def _dealt(left: DataFrame) -> DataFrame:
    """Lines code, k, c that `_apart` gives, dealt out by two more classes: lines that agree in AGREE classes, a band's two among them, meet in a `deal`."""
    codes = F.array(*(F.lit(i * BINS + j) for i, j in combinations(range(BINS), 2)))
    each = left.select("code", "k", "c", "part", "band", "bucket", F.array(*CLASSES).alias("m"), F.explode(codes).alias("pair"))
    each = each.withColumn("i", F.floor(F.col("pair") / BINS).cast("int")).withColumn("j", F.col("pair") % BINS)
    each = each.where("i div 2 <> band AND j div 2 <> band")
    dealt = each.select("code", "k", "c", "part", F.xxhash64("bucket", "pair", F.get("m", "i"), F.get("m", "j")).alias("deal"))
    several = dealt.groupBy("deal").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("deal")
    return sieve(dealt, "deal", several, "deal").join(several, "deal").select("deal", "code", "k", "c", "part")


def _named(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of codes (a, b) with the lines' names."""
    one, two = (near.select(F.col("code").alias(x), F.col("k").alias(f"{x}k"), F.col("c").alias(f"{x}c")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("ak", "ac", "bk", "bc")


def _around(dealt: DataFrame, step: int) -> DataFrame:
    """Pairs of codes: a line of each deal, by an order of the deal's own, with those of its lines that are in other components. As many at most as there are lines in deals."""
    turn = F.xxhash64("deal", F.lit(step))
    hubs = dealt.groupBy("deal").agg(F.min(F.col("code").bitwiseXOR(turn)).alias("least"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    hubs = hubs.select("deal", F.col("least").bitwiseXOR(turn).alias("a"))
    pairs = dealt.join(hubs, "deal").select("a", F.col("code").alias("b"), F.col("part").alias("of_b")).distinct()
    known = dealt.select(F.col("code").alias("a"), F.col("part").alias("of_a")).distinct()
    return pairs.join(known, "a").where("of_a <> of_b").select("a", "b")


def _left(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of codes of each deal's lines of different components that sizes and parities (`sets`, by code) don't rule out. Lines of the deal's own first component are not paired with each other."""
    groups = dealt.groupBy("deal").agg(F.min("part").alias("home"), F.max("part").alias("hi")).where("home <> hi").select("deal", "home")
    some = dealt.join(groups, "deal")
    side = lambda x: sets.select(*(F.col(c).alias(f"{x}{c}") for c in sets.columns))
    a = some.where("part <> home").select(F.col("deal").alias("at"), F.col("part").alias("of_a"), F.col("code").alias("acode")).join(side("a"), "acode")
    b = some.select("deal", "home", F.col("part").alias("of_b"), F.col("code").alias("bcode")).join(side("b"), "bcode")
    once = (F.col("of_b") == F.col("home")) | (F.col("acode") < F.col("bcode"))
    met = a.join(b, (F.col("at") == F.col("deal")) & (F.col("of_a") != F.col("of_b")) & once & _may_link())
    return met.select(F.col("acode").alias("a"), F.col("bcode").alias("b")).distinct()


def _parted(listed: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs of codes (a, b) whose lines are in different components."""
    parts = _with_part(names, found).select("code", "part")
    for x in "ab":
        listed = listed.join(parts.select(F.col("code").alias(x), F.col("part").alias(f"of_{x}")), x)
    return listed.where("of_a <> of_b").select("a", "b")


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs (ak, ac, bk, bc) that agree in AGREE classes: all of a small bucket, of a larger one its hub with the others."""
    rows = members.select("bucket", "code", *KEY, *CLASSES)
    small, large = rows.where(F.col("m") <= SMALL), rows.where(F.col("m") > SMALL)
    all_ = _as(small, "a").join(_as(small, "b"), (F.col("abucket") == F.col("bbucket")) & (F.col("acode") < F.col("bcode")) & (_agreeing("a", "b") >= AGREE))
    hubs = _as(members.where((F.col("m") > SMALL) & (F.col("code") == F.col("hub"))).select(*rows.columns), "a")
    around = hubs.join(_as(large, "b"), (F.col("abucket") == F.col("bbucket")) & (F.col("acode") < F.col("bcode")) & (_agreeing("a", "b") >= AGREE))
    names = ("ak", "ac", "bk", "bc")
    return all_.select(*names).union(around.select(*names)).distinct()


def _merged(found: DataFrame, links: DataFrame, kept: Kept) -> DataFrame:
    """The components `found` (node, component), united by `links`: only the components that these name go through the rounds again."""
    edges = links
    for x in "ab":
        of = found.select(F.col("node").alias(x), F.col("component").alias("of"))
        edges = edges.join(of, x, "left").withColumn(x, F.coalesce("of", x)).drop("of")
    over = kept.write(components(edges.select("a", "b"), kept))
    names = over.select(F.col("node").alias("component"), F.col("component").alias("new"))
    moved = found.join(names, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return kept.write(moved.union(over.join(found.select("node"), "node", "left_anti").select("node", "component")))


def _second(lines: DataFrame, found: DataFrame, listed: DataFrame, dealt: DataFrame, names: DataFrame, kept: Kept) -> DataFrame:
    """The components `found`, united by what links `listed` pairs and lines that are `dealt` out; `names` has the lines of both."""
    verifier = _Verifier(lines, names, kept)
    sets = kept.write(_parities(verifier.texts).join(names, list(KEY)).drop(*KEY))
    bounded = lambda pairs: pairs.join(_as(sets, "a").withColumnRenamed("acode", "a"), "a").join(_as(sets, "b").withColumnRenamed("bcode", "b"), "b").where(_may_link()).select("a", "b")
    listed, old = kept.write(bounded(listed.select("a", "b"))), listed
    kept.drop(old)
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            # as copies resemble their original, the first of a line's pairs mostly spares the others
            pairs = bounded(_around(dealt, step)).union(listed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        else:
            # what hubs could not unite is compared in full
            pairs = _left(dealt, sets).union(_parted(listed, names, found))
        met = verifier.links(_named(pairs.distinct(), names))
        more = met.where("alike").select("a", "b")
        if not more.isEmpty():
            found, before = _merged(found, more, kept), found
            if step < ROUNDS:
                parts = _with_part(names, found).select("code", "part")
                dealt, old = kept.write(dealt.select("deal", "code").join(parts, "code").select("deal", "code", "part")), dealt
                kept.drop(old)
            kept.drop(before)
        kept.drop(met)
    verifier.drop()
    kept.drop(names, sets, listed, dealt)
    return found


def line_components(lines: DataFrame, keys: DataFrame, kept: Kept) -> DataFrame:
    """k, c and component of each line that resembles a different one; `keys` has each line's name and signature."""
    bands = F.array(*(F.when(F.col(one).isNotNull() | F.col(two).isNotNull(), F.xxhash64(F.lit(j), one, two)) for j, (one, two) in enumerate(zip(CLASSES[::2], CLASSES[1::2], strict=True))))
    # an array of numbers is taken apart in compiled code
    banded = keys.select(_code(), *KEY, *CLASSES, F.posexplode(bands).alias("band", "bucket")).where("bucket is not null")
    hubs = kept.write(banded.groupBy("bucket").agg(F.min("code").alias("hub"), F.count("*").alias("m")).where("m > 1"))
    members = kept.write(sieve(banded, "bucket", hubs, "bucket").join(hubs, "bucket"))
    kept.drop(hubs)
    pairs = kept.write(_pairs(members))
    verifier = _Verifier(lines, pairs.select(F.explode(F.array(*(F.struct(F.col(f"{x}k").alias("k"), F.col(f"{x}c").alias("c")) for x in "ab"))).alias("key")).select("key.*"), kept)
    links = verifier.links(pairs)
    found = kept.write(components(links.where("alike").select("a", "b"), kept))
    verifier.drop()
    kept.drop(pairs, links)
    # small buckets are done
    apart = kept.write(_apart(members.where(F.col("m") > SMALL), found))
    kept.drop(members)
    listed = kept.write(_listed(apart.where(F.col("m") <= MEDIUM)))
    dealt = kept.write(_dealt(apart.where(F.col("m") > MEDIUM)))
    kept.drop(apart)
    either = [listed.select(F.col(x).alias("code"), F.col(f"{x}k").alias("k"), F.col(f"{x}c").alias("c")) for x in "ab"]
    names = kept.write(dealt.select("code", *KEY).union(either[0]).union(either[1]).distinct())
    if names.isEmpty():
        kept.drop(listed, dealt, names)
    else:
        found = _second(lines, found, listed, dealt, names, kept)
    return found.select("node.k", "node.c", F.struct("component.k", "component.c").alias("component"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id and `drop`, the places of the lines that go."""
    kept = Kept(docs.sparkSession)
    # texts are split once; what follows reads the columns that it needs
    lines = kept.write(_lines(docs.select("doc_id", "text")))
    keys = kept.write(signatures(lines))
    near = line_components(lines, keys, kept)
    # lines that occur once and resemble none take no part
    united = keys.where("times > 1").select(*KEY).join(near.hint("merge"), list(KEY), "full")
    united = kept.write(united.select("k", "c", F.coalesce("component", F.struct("k", "c")).alias("component")))
    occurrences = sieve(lines.select("doc_id", "at", "k", "c"), "k", united, "k").join(united, list(KEY))
    occurrences = kept.write(occurrences.select("doc_id", "at", F.xxhash64("component.k", "component.c").alias("h"), "component"))
    stays = occurrences.groupBy("component").agg(F.min(F.struct("doc_id", "at")).alias("stay"))
    gone = occurrences.join(stays, "component").where(F.struct("doc_id", "at") != F.col("stay"))
    out = kept.write(gone.groupBy("doc_id").agg(F.collect_set("at").alias("drop")))
    kept.drop(lines, keys, united, occurrences)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with each text's lines that repeat or resemble an earlier one left out."""
    of, drop = fresh(docs, "of"), fresh(docs, "drop")
    gone = dropped_lines(docs).select(F.col("doc_id").alias(of), F.col("drop").alias(drop))
    joined = docs.join(gone.hint("merge"), docs["doc_id"] == gone[of], "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(drop, i))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
