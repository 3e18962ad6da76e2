"""Variant spellings of one person's or organisation's name.

1. Names are cut into tokens (accents, case, quotes, titles, places such as "work"
   and legal forms play no role) and the distinct tokens of all names form a
   vocabulary with frequencies.
2. A prefix-filtered set-similarity join on the tokens' q-grams finds tokens that
   differ by a typing error: of each token only the rarest q-grams that an error
   can't all destroy are joined, tokens of nine and more letters also by what is left
   of them without any two letters (two errors), and pairs that meet are verified by
   their edit distance. A rarer token is read as the more frequent one it resembles.
3. Short forms of given names come from the nickname table, and are learned where
   two common tokens stand beside the same rare ones again and again.
4. Names that share a rare token are compared by soft weighted token similarity:
   equal tokens, errors, short forms, abbreviations and initials count, and a token
   counts the more the rarer it is; a common token that contradicts (another given
   name, another line of business) separates. Names of the address book that agree
   make up an entity, the other names join the entity they agree with.
5. A surname that is cut to its beginning ("Gobpab.") is looked up by that beginning
   together with the other token, and counts if only one entity fits.

A token that stands beside many different ones (a given name, a line of business,
a frequent surname) is common and never the only thing two names share. Names
without a rare token are folded to what they say, meet through every two common
tokens they share and are told apart by what they say besides. Then short forms,
abbreviations and initials beside common tokens are looked up by what they may stand
for; as so many share a common token, they count only if one entity fits.

Defined cases: null, blank and placeholder names are no names; an initial that
fits two entities fits none; equal names are treated once; contacts without numbers
take part; ties take the smaller contact_id.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.components import connected
from recordloom.operators.packed import packed_values
from recordloom.session import cut

#: Words of a name that say nothing about who it is.
NOISE = frozenset(
    "dr prof professor mr mrs ms miss sir herr frau rev the and und of for jr sr "
    "work home mobile cell office fax main front desk reception private new old "
    "company co incorporated inc limited ltd llc gmbh corp corporation sons son bros".split()
)
#: Whole names that stand for nothing.
PLACEHOLDERS = frozenset(("unknown", "unknown caller", "unknown number", "private", "private number", "anonymous", "restricted", "n/a", "na", "null", "none", "nan", ""))
#: q of the q-grams, and how many of them one typing error (an exchange of neighbours at worst) destroys.
Q, DESTROYED = 4, 5
#: From how many letters two errors are accepted, and up to how many they are found by leaving out letters (longer ones by more q-grams).
TWO_ERRORS, LEFT_OUT = 9, 26
#: A reading is common from so many times the median number of different neighbours, and from so many at least; neighbours seen less than NEIGHBOUR_FREQ times don't count.
COMMON_DEGREES, LEAST_COMMON, NEIGHBOUR_FREQ = 4, 12, 3
#: Up to how many names a token is read as any more frequent one it resembles, and how many times more frequent the other must be beyond.
SELDOM, MEANT = 3, 5
#: A learned short form: rare tokens that two tokens share, the part of the way from chance to certainty that the share has to go, and by how many deviations the count must exceed chance.
LEARN_COUNT, LEARN_EXCESS, LEARN_SIGMAS = 4, 0.7, 3
#: Score of a link that holds only if a name has no other such link.
MAYBE = 0.4

_QUOTED = re.compile(r'"[^"]*"|\([^)]*\)|“[^”]*”')
_TOKEN = re.compile(r"\d+/\d+|(?<![^\W\d_])[^\W\d_]/[^\W\d_](?![^\W\d_])|[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")


def parse_name(text: str | None) -> tuple[list[str], list[str], list[str]]:
    """(tokens, initials, cut tokens) of a name; all empty for a placeholder."""
    if text is None:
        return [], [], []
    s = _QUOTED.sub(" ", text)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("_", " ")
    if " ".join(s.lower().strip(" ()").split()) in PLACEHOLDERS:
        return [], [], []
    s = _CAMEL.sub(" ", s)
    tokens, initials, cuts = [], [], []
    for m in _TOKEN.finditer(s):
        raw = m.group().lower()
        dot = raw.endswith(".")
        t = re.sub(r"['’]s?$", "", raw.rstrip("."))
        t = t.replace("'", "").replace("’", "")
        if not t or t in NOISE:
            continue
        if len(t) == 1:
            initials.append(t)
        elif dot:
            cuts.append(t)
        else:
            tokens.append(t)
    return list(dict.fromkeys(tokens)), list(dict.fromkeys(initials)), list(dict.fromkeys(cuts))


def close(a: str, b: str) -> bool:
    """One typing error apart at most: a letter replaced, added, left out or exchanged with its neighbour; two in tokens of nine and more letters that begin alike."""
    return _distance(a, b, 2) <= (1 if min(len(a), len(b)) < TWO_ERRORS or a[0] != b[0] else 2)


def _distance(a: str, b: str, most: int) -> int:
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def abbreviates(short: str, long: str) -> bool:
    """Is ``short`` the beginning of ``long``, or its letters in order from the first without most vowels?"""
    if len(short) >= len(long) or len(short) < 2 or short[0] != long[0]:
        return False
    if long.startswith(short):
        return len(short) >= 3
    if sum(c in "aeiou" for c in short) > 1:
        return False
    letters = iter(long)
    return all(c in letters for c in short)


def parsed_names(values: DataFrame) -> DataFrame:
    """val, contact_id, tokens, initials, cuts of each distinct name; ``values``: src, row_id, val."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, c, *parse_name(v)) for v, c in batch.itertuples(index=False, name=None)]
            out = pd.DataFrame([r for r in rows if r[2] or r[4]], columns=["val", "contact_id", "tokens", "initials", "cuts"])
            yield out.assign(contact_id=out["contact_id"].astype("Int64"))

    distinct = values.where("val is not null").groupBy("val").agg(F.min(F.when(F.col("src") == "contacts", F.col("row_id"))).alias("contact_id"))
    return distinct.mapInPandas(run, "val string, contact_id bigint, tokens array<string>, initials array<string>, cuts array<string>")


def vocabulary(names: DataFrame) -> DataFrame:
    """token, freq (distinct names that hold it), contacts (of them in the address book)."""
    each = names.select("contact_id", F.explode("tokens").alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count("contact_id").alias("contacts"))


def _tasks(df: DataFrame) -> int:
    """Tasks of a step that makes much of little input, which AQE would merge by the size of the input."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _two_errors(words: DataFrame) -> DataFrame:
    """token, other, f1, f2: seldom tokens and those they may be meant for that are equal without two letters of each at most, as all are that two errors separate."""

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                out = []
                for t, f in batch[["token", "freq"]].iloc[start : start + 1000].itertuples(index=False, name=None):
                    one = {t[:i] + t[i + 1 :] for i in range(len(t))}
                    out += [(t, f, x) for x in {t} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}]
                yield pd.DataFrame(out, columns=["token", "freq", "left"])

    asked = words.where(F.length("token").between(TWO_ERRORS, LEFT_OUT) & ((F.col("freq") <= SELDOM) | (F.col("freq") >= MEANT)))
    # both begin alike
    lefts = asked.select("token", "freq").repartition(_tasks(words), "token").mapInPandas(left, "token string, freq bigint, left string").select("token", "freq", F.xxhash64(F.substring("token", 1, 1), "left").alias("left"))
    a = lefts.where(F.col("freq") <= SELDOM).select("left", "token", F.col("freq").alias("f1"))
    b = lefts.where(F.col("freq") >= MEANT).select("left", F.col("token").alias("other"), F.col("freq").alias("f2"))
    return a.join(b, "left").where(F.col("f2") >= MEANT * F.col("f1")).select("token", "other", "f1", "f2").distinct()


def similar_tokens(words: DataFrame) -> DataFrame:
    """token, other, f2 (the frequency of the other), d (their distance): pairs that typing errors separate, the more frequent one as ``other``."""
    long_enough = words.where(F.length("token") >= 4).select("token", "freq", "contacts", F.concat(F.lit("^" * (Q - 1)), "token", F.lit("$" * (Q - 1))).alias("padded"))
    grams = long_enough.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("padded") - (Q - 1)), lambda i: F.col("padded").substr(i, F.lit(Q))))))
    weights = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # of a token's grams, the rarest: one error destroys at most DESTROYED, so one of the first DESTROYED + 1 survives; two errors twice as many
    long, first = F.length("token") > LEFT_OUT - 2, F.array_sort(F.collect_list(F.struct("df", "gram")))
    prefixes = (
        grams.join(weights, "gram").groupBy("token", "freq", "contacts")
        .agg(first.alias("first")).withColumn("first", F.slice("first", F.lit(1), F.when(long, 2 * DESTROYED + 1).otherwise(DESTROYED + 1)))
        .select("token", "freq", "contacts", F.explode("first.gram").alias("gram"))
        .repartition(_tasks(words), "gram")
    )
    a = prefixes.select(F.col("gram"), F.col("token"), F.col("freq").alias("f1"), F.col("contacts").alias("c1"))
    b = prefixes.select(F.col("gram"), F.col("token").alias("other"), F.col("freq").alias("f2"), F.col("contacts").alias("c2"))
    ahead = (F.col("f2") > F.col("f1")) | ((F.col("f2") == F.col("f1")) & ((F.col("c2") > F.col("c1")) | ((F.col("c2") == F.col("c1")) & (F.col("other") < F.col("token")))))
    # what is written often is meant, unless the other is written far more often
    more = ahead & ((F.col("f1") <= SELDOM) | (F.col("f2") >= MEANT * F.col("f1")))
    near = F.abs(F.length("token") - F.length("other")) <= 2
    # an exchange counts as two here
    apart = (F.levenshtein("token", "other", 2) >= 0) | (long & (F.levenshtein("token", "other", 4) >= 0))
    pairs = a.join(b, "gram").where(more & near & apart).select("token", "other", "f1", "f2").unionByName(_two_errors(words)).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = [_distance(x, y, 2) for x, y in zip(batch["token"], batch["other"])]
            far = [x == 2 and not (close(a, b) and f <= SELDOM and g >= MEANT * f) for x, a, b, f, g in zip(d, batch["token"], batch["other"], batch["f1"], batch["f2"])]
            batch = batch.assign(d=d)
            yield batch[[x <= 2 and not y for x, y in zip(d, far)]][["token", "other", "f2", "d"]].astype({"d": "int32"})

    return pairs.mapInPandas(verify, "token string, other string, f2 bigint, d int")


def readings(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """token, reading (the token it is read as), common, freq, longs (what it may be short for).

    A reading is common if it stands beside far more different ones than the median
    reading of the address book does: a given name beside many surnames, while a
    surname stands beside the given names of its bearers only.
    """
    words = cut(vocabulary(names))
    given = nicknames.select(F.lower("nick").alias("reading"), F.lower("given").alias("long")).where("reading is not null and long is not null").distinct()
    spelt = given.select(F.explode(F.array("reading", "long")).alias("token")).distinct()
    best = similar_tokens(words).groupBy("token").agg(F.max_by("other", F.struct(-F.col("d"), "f2", "other")).alias("reading")).join(spelt, "token", "left_anti")
    read = cut(words.join(best, "token", "left").select("token", F.coalesce("reading", "token").alias("reading"), "freq", "contacts"))
    about = read.groupBy("reading").agg(F.sum("freq").alias("freq"), F.sum("contacts").alias("contacts"))
    seen = names.select("val", F.explode("tokens").alias("token")).join(read.select("token", "reading"), "token").select("val", "reading").distinct()
    beside = seen.join(seen.select("val", F.col("reading").alias("neighbour")), "val").where("reading <> neighbour").select("reading", "neighbour").distinct()
    known = about.where(F.col("freq") >= NEIGHBOUR_FREQ).select(F.col("reading").alias("neighbour"))
    degrees = beside.join(known, "neighbour").groupBy("reading").agg(F.count(F.lit(1)).alias("degree"))
    about = cut(about.join(degrees, "reading", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    usual = about.where((F.col("contacts") > 0) & (F.col("freq") >= NEIGHBOUR_FREQ)).agg(F.percentile_approx("degree", 0.5, 1000)).first()[0] or 0
    flagged = about.select("reading", "freq", (F.col("degree") >= max(LEAST_COMMON, COMMON_DEGREES * usual)).alias("common"))
    return read.select("token", "reading").join(flagged, "reading").join(given.groupBy("reading").agg(F.collect_set("long").alias("longs")), "reading", "left")


def learned_short_forms(tokens: DataFrame) -> DataFrame:
    """reading, long: tokens that nearly always stand beside rare tokens that a certain common one stands beside too; ``tokens``: val, reading, common.

    Most names with "Sandy" and a rare surname have a counterpart with "Alexander" and
    the same surname, far more than names have a counterpart with "Alexander". Pairs
    are formed per rare token among the tokens beside it, of which there are as many
    as different given names of one surname.
    """
    rare = tokens.where("not common").select("val", F.col("reading").alias("anchor")).distinct()
    beside = cut(tokens.select("val", "reading", "common").join(rare, "val").where("reading <> anchor").select("anchor", "reading", "common").distinct())
    alone = cut(beside.groupBy("reading", "common").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEARN_COUNT))
    frequent = beside.join(alone.select("reading"), "reading", "left_semi")
    other = frequent.where("common").select("anchor", F.col("reading").alias("long"))
    pairs = cut(frequent.join(other, "anchor").where("reading <> long").groupBy("reading", "long", "common").agg(F.count(F.lit(1)).alias("c")))
    # how often a rare token that any common one stands beside has this one beside it too
    places = float(alone.where("common").agg(F.sum("n")).first()[0] or 1)
    base = pairs.where("common").groupBy("long").agg((F.sum("c") / F.lit(places)).alias("chance"))
    n, share, chance = F.col("n"), F.col("c") / F.col("n"), F.least(F.col("chance"), F.lit(1.0))
    sure = F.col("c") - n * chance >= LEARN_SIGMAS * F.sqrt(n * chance * (1 - chance) + 0.5)
    good = (F.col("c") >= LEARN_COUNT) & (share - chance >= LEARN_EXCESS * (1 - chance)) & sure
    return pairs.join(alone.select("reading", "n"), "reading").join(base, "long").where(good).select("reading", "long")


def _agreement(a: tuple, b: tuple) -> float:
    """Agreement of the tokens beside the anchor; 0 if they contradict or say nothing."""
    best = 0.0
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            w = max(a[3][i], b[3][j])
            if x == y:
                s = 1.0
            elif y in a[4][i] or x in b[4][j] or set(a[4][i]) & set(b[4][j]):
                s = 0.95
            elif len(x) > 3 and len(y) > 3 and close(x, y):
                s = 0.9
            elif abbreviates(x, y) or abbreviates(y, x):
                s = 0.8
            else:
                continue
            best = max(best, s + 0.001 * w)
    for x, others in ((c, b) for c in a[6]):
        best = max([best, *(0.8 for y in others[2] if abbreviates(x, y))])
    for y, others in ((c, a) for c in b[6]):
        best = max([best, *(0.8 for x in others[2] if abbreviates(y, x))])
    if best:
        return best
    if a[6] and b[6] and set(a[6]) & set(b[6]):
        return 0.8
    full_a, full_b = a[2] or a[6], b[2] or b[6]

    def fits(initial: str, other: tuple) -> float:
        """An initial stands for a given name rather than for its short form."""
        heads = [(y[0], not longs) for y, longs in zip(other[2], other[4])] + [(y[0], True) for y in other[6]]
        return max((0.6 if whole else 0.5 for h, whole in heads if h == initial), default=0.0)

    if not full_a and a[5]:
        return fits(a[5][0], b) if full_b else (0.6 if a[5][0] in b[5] else 0.0)
    if not full_b and b[5]:
        return fits(b[5][0], a)
    return 0.0 if full_a or full_b else 0.5


def _resolve(rows: list[tuple]) -> list[tuple]:
    """Links of the names that share an anchor: (val, contact_id, score).

    ``rows``: (val, contact_id, rest, weights, longs, initials, cuts).
    """
    book = [r for r in rows if r[1] is not None]
    if not book:
        return []

    parent = list(range(len(book)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    # names with a full token beside the anchor first, by what they say; then initials, if they fit only one
    full = [i for i, r in enumerate(book) if r[2] or r[6]]
    for n, i in enumerate(full):
        for j in full[:n]:
            if _agreement(book[i], book[j]) >= 0.75:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for i in (i for i in range(len(book)) if i not in set(full)):
        agreed = {j: _agreement(book[i], book[j]) for j in full}
        fits = {root(j) for j, s in agreed.items() if s and s >= max(agreed.values()) - 0.04}
        if len(fits) == 1:
            parent[i] = fits.pop()
        elif not fits:
            same = [j for j in range(i) if j not in set(full) and _agreement(book[i], book[j]) > 0]
            if same:
                parent[i] = root(same[0])
    smallest: dict[int, int] = {}
    for i, r in enumerate(book):
        smallest[root(i)] = min(smallest.get(root(i), r[1]), r[1])
    out = [(r[0], smallest[root(i)], 2.0) for i, r in enumerate(book)]
    for r in (r for r in rows if r[1] is None):
        scores: dict[int, float] = {}
        for i, b in enumerate(book):
            s = _agreement(r, b)
            if s:
                scores[smallest[root(i)]] = max(scores.get(smallest[root(i)], 0.0), s)
        if not scores:
            continue
        top = max(scores.values())
        fits = [c for c, s in scores.items() if s >= top - 0.04]
        if len(fits) == 1 or top >= 0.85:
            out.append((r[0], min(fits), top))
    return out


def _resolve_pairs(rows: list[tuple]) -> list[tuple]:
    """Links of what names say that share two common tokens: as ``_resolve``, and with MAYBE what says no more than the two, which fits what says more if that is one entity."""
    said = [r for r in rows if r[2] or r[5] or r[6]]
    out = _resolve(said)
    entities, linked = {c for _, c, s in out if s >= 2}, {v for v, _, _ in out}
    for bare in (r for r in rows if not (r[2] or r[5] or r[6])):
        if bare[1] is None:
            out += [(bare[0], c, 0.5) for c in entities if len(entities) == 1]
        else:
            more = [r for r in said if (len(entities) == 1 and r[1] is not None) or (len(entities) != 1 and r[0] not in linked)]
            out += [(bare[0], bare[1], 2.0), *((r[0], bare[1], MAYBE) for r in more)]
    return out


_LINK = "val string, contact_id bigint, score double"


def _folded(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(val, form of each name; the forms with their smallest contact_id, as ``whole`` with the form as val).

    A form is what a name says: its readings, initials and cut tokens. Spellings that
    say the same are compared once, so no step behind this one grows with them.
    """
    said = F.concat_ws("|", F.array_join(F.transform("all", lambda t: t["reading"]), " "), F.array_join(F.array_sort("initials"), " "), F.array_join(F.array_sort("cuts"), " "))
    named = cut(whole.withColumn("form", said))
    forms = named.groupBy("form").agg(F.min("contact_id").alias("contact_id"), F.any_value("all").alias("all"), F.min("initials").alias("initials"), F.min("cuts").alias("cuts"))
    return named.select("val", "form"), cut(forms.select(F.col("form").alias("val"), "contact_id", "initials", "cuts", "all"))


def name_links(values: DataFrame, nicknames: DataFrame) -> DataFrame:
    """val, contact_id: the entity (its smallest contact_id) of each distinct name that belongs to one."""
    names = cut(parsed_names(values))
    vocab = cut(readings(names, nicknames))
    none = F.array().cast("array<struct<reading:string,common:boolean,freq:bigint,longs:array<string>>>")
    token = F.struct("reading", "common", "freq", F.coalesce("longs", F.array().cast("array<string>")).alias("longs"))
    each = names.select("val", F.explode("tokens").alias("token")).join(vocab, "token").groupBy("val").agg(F.array_sort(F.collect_set(token)).alias("all"))
    spelt, forms = _folded(names.select("val", "contact_id", "initials", "cuts").join(each, "val", "left").withColumn("all", F.coalesce("all", none)))
    each = forms.select("val", F.explode("all").alias("t")).select("val", "t.*")
    learned = learned_short_forms(each).groupBy("reading").agg(F.collect_set("long").alias("more"))
    short = cut(each.select("reading").distinct().join(learned, "reading"))
    if short.isEmpty():
        whole = forms
    else:
        more = each.join(short, "reading").select("val", F.struct("reading", "more").alias("m")).groupBy("val").agg(F.collect_list("m").alias("more"))
        longer = F.transform("all", lambda t: t.withField("longs", F.array_distinct(F.concat(t["longs"], F.flatten(F.transform(F.filter("more", lambda m: m["reading"] == t["reading"]), lambda m: m["more"]))))))
        whole = cut(forms.join(more, "val", "left").withColumn("all", F.when(F.col("more").isNull(), F.col("all")).otherwise(longer)).drop("more"))
    each = whole.select("val", F.explode("all").alias("t")).select("val", "t.*")
    rare = F.transform(F.filter("all", lambda t: ~t["common"]), lambda t: t["reading"])
    blocks = whole.withColumn("anchor", F.explode(rare)).select("anchor", "val", "contact_id", F.filter("all", lambda t: t["reading"] != F.col("anchor")).alias("beside"), "initials", "cuts")
    # a contact of two blocks belongs to the smaller entity; a name takes the entity it agrees with best
    linked = cut(_resolved(blocks, _resolve).groupBy("val").agg(F.min_by("contact_id", F.struct(-F.col("score"), "contact_id")).alias("contact_id"), F.max("score").alias("score")))
    linked = cut(_common_links(whole, linked.unionByName(_common_pairs(whole)), each, nicknames))
    found = cut(linked.select("val", "contact_id").unionByName(_short_surnames(whole, linked)))
    found = found.unionByName(_distant_surnames(whole, linked, found))
    return spelt.join(found.withColumnRenamed("val", "form"), "form").select("val", "contact_id")


def _resolved(blocks: DataFrame, how: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """val, contact_id, score: the links of each block; ``blocks``: anchor, val, contact_id, beside, initials, cuts."""
    blocks = blocks.repartition(_tasks(blocks), "anchor").sortWithinPartitions("anchor", F.col("contact_id").asc_nulls_last(), "val")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_anchor, rows = None, []
        for batch in batches:
            out = []
            for anchor, val, contact, beside_, initials, cuts in batch.itertuples(index=False, name=None):
                if anchor != open_anchor:
                    out += how(rows)
                    open_anchor, rows = anchor, []
                rows.append((
                    val, None if contact is None or pd.isna(contact) else int(contact), [t["reading"] for t in beside_], [1 / math.log(2 + t["freq"]) for t in beside_],
                    [list(t["longs"]) for t in beside_], list(initials), list(cuts),
                ))
            yield pd.DataFrame(out, columns=["val", "contact_id", "score"]).astype({"contact_id": "int64", "score": "float64"})
        yield pd.DataFrame(how(rows), columns=["val", "contact_id", "score"]).astype({"contact_id": "int64", "score": "float64"})

    return blocks.mapInPandas(resolve, _LINK)


def _merged(links: DataFrame, edges: DataFrame) -> DataFrame:
    """``links`` with the entities that ``edges`` (a, b) connect as one."""
    if edges.isEmpty():
        return links
    return cut(links.join(connected(edges).withColumnRenamed("node", "contact_id"), "contact_id", "left").select("val", F.coalesce("label", "contact_id").alias("contact_id"), "score"))


def _common_pairs(whole: DataFrame) -> DataFrame:
    """val, contact_id, score of the names without a rare token, by each two common tokens they share.

    Names are folded to what they say, so a pair that a third of the names hold makes
    a block of its different additions only.
    """
    key = F.concat_ws("|", *[F.array_join(c, " ") for c in (F.transform("all", lambda t: t["reading"]), F.array_sort("initials"), F.array_sort("cuts"))])
    plain = whole.where((F.size(F.filter("all", lambda t: ~t["common"])) == 0) & (F.size("all") > 0) & (F.size("all") + F.size("initials") + F.size("cuts") > 1)).withColumn("form", key)
    forms = cut(plain.groupBy("form").agg(F.min("contact_id").alias("contact_id"), F.any_value("all").alias("all"), F.min("initials").alias("initials"), F.min("cuts").alias("cuts")))
    pairs = forms.select("form", "contact_id", "all", F.explode("all.reading").alias("a")).select("form", "contact_id", "a", F.explode("all.reading").alias("b")).where("a < b").select("form", "contact_id", F.concat_ws(" ", "a", "b").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count("contact_id").alias("book")).where("n > 1 and book > 0")
    met = pairs.select("form", "anchor").join(shared.select("anchor"), "anchor", "left_semi").join(forms, "form")
    blocks = met.select("anchor", F.col("form").alias("val"), "contact_id", F.filter("all", lambda t: ~F.array_contains(F.split("anchor", " "), t["reading"])).alias("beside"), "initials", "cuts")
    # what stands in the address book is an entity, whether it meets others or not
    alone = forms.where("contact_id is not null").select(F.col("form").alias("val"), "contact_id", F.lit(2.0).alias("score"))
    links = cut(_resolved(blocks, _resolve_pairs).unionByName(alone))
    # a name that adds to two entities, or agrees with two equally little, belongs to none
    sure = links.where(F.col("score") > MAYBE).groupBy("val").agg(F.min_by("contact_id", F.struct(-F.col("score"), "contact_id")).alias("contact_id"), F.max_by("contact_id", F.struct("score", "contact_id")).alias("last"), F.max("score").alias("score"))
    maybe = links.where(F.col("score") == MAYBE).groupBy("val").agg(F.min("contact_id").alias("contact_id"), F.max("contact_id").alias("last"), F.lit(MAYBE).alias("score")).where("contact_id = last")
    sure = cut(sure.where("score >= 0.75 or contact_id = last").drop("last"))
    maybe = cut(maybe.drop("last"))
    edges = links.where("score >= 2").unionByName(maybe).join(alone.select("val", F.col("contact_id").alias("b")), "val").select(F.col("contact_id").alias("a"), "b").where("a <> b")
    best = sure.unionByName(maybe.join(links.where(F.col("score") > MAYBE).select("val").distinct(), "val", "left_anti"))
    return plain.select("val", "form").join(_merged(best, edges).withColumnRenamed("val", "form"), "form").select("val", "contact_id", "score")


def _abbreviated(each: DataFrame, nicknames: DataFrame) -> DataFrame:
    """reading, long: readings without a vowel behind the first letter, no given names, that abbreviate a common one."""
    spelt = nicknames.select(F.explode(F.array(F.lower("nick"), F.lower("given"))).alias("reading"))
    short = each.select("reading").distinct().where(F.col("reading").rlike("^[a-z][b-df-hj-np-tv-z]+$")).join(spelt, "reading", "left_anti")
    short = short.select("reading", F.substring("reading", 1, 1).alias("first"), F.substring("reading", 2, 1).alias("second"), F.array_join(F.split("reading", ""), ".*").alias("letters"))
    long = each.where("common").select(F.col("reading").alias("long")).distinct()
    long = long.select("long", F.substring("long", 1, 1).alias("first"), F.explode(F.array_distinct(F.split(F.expr("substring(long, 2)"), ""))).alias("second"))
    return short.join(long, ["first", "second"]).where((F.length("reading") < F.length("long")) & F.expr("long rlike concat('^', letters)")).select("reading", "long")


def _common_links(whole: DataFrame, links: DataFrame, each: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``links`` and those of short forms, abbreviations and initials that stand beside common tokens only.

    Entities offer each token beside each other one, asked for by what a short form may
    stand for; an offer is folded to the smallest and the largest entity, which are equal
    if only one fits. Names of three and more tokens ask names of two, since those of
    more that they share a pair with were compared as wholes.
    """
    links = cut(links)
    abbreviated = _abbreviated(each, nicknames).groupBy("reading").agg(F.collect_set("long").alias("abbreviated"))
    several = F.size(F.filter("all", lambda t: ~t["common"]))
    beside = whole.where((several <= 1) & (F.size("all") > 1)).select("val", "contact_id", F.size("all").alias("size"), "all", several.alias("rare"), F.explode("all").alias("t")).where("rare = 0 or not t.common")
    beside = beside.select("val", "contact_id", "size", F.col("t.reading").alias("reading"), F.col("t.longs").alias("longs"), F.explode("all").alias("b")).where("b.common and b.reading <> reading")
    none = F.array().cast("array<string>")
    beside = beside.join(abbreviated, "reading", "left").select("val", "contact_id", "size", "reading", F.array_distinct(F.concat("longs", F.coalesce("abbreviated", none))).alias("longs"), F.col("b.reading").alias("other"))
    beside = cut(beside)
    initial = whole.where((several == 0) & (F.size("all") == 1) & (F.size("initials") > 0)).select("val", "contact_id", F.lit("any").alias("of"), F.concat(F.col("initials")[0], F.lit(".")).alias("said"), F.col("all")[0]["reading"].alias("other"), F.lit(True).alias("strict"))
    of = F.when(F.col("size") == 2, "any").otherwise("two")

    def targets(links: DataFrame, asked: DataFrame) -> DataFrame:
        book = beside.where("contact_id is not null").drop("contact_id").join(links.where("score >= 2").select("val", F.col("contact_id").alias("entity")), "val")
        own, head = F.struct(F.col("reading").alias("said"), F.lit(0).alias("rank")), F.struct(F.concat(F.substring("reading", 1, 1), F.lit(".")).alias("said"), (F.size("longs") > 0).cast("int").alias("rank"))
        whats = F.concat(F.array(own, head), F.transform("longs", lambda x: F.struct(x.alias("said"), F.lit(1).alias("rank"))))
        offers = book.select("entity", "other", "size", F.explode(whats).alias("w")).select("entity", "other", "w.said", "w.rank", F.explode(F.when(F.col("size") == 2, F.array(F.lit("any"), F.lit("two"))).otherwise(F.array(F.lit("any")))).alias("of"))
        lows = [f(F.when(F.col("rank") == k, F.col("entity"))).alias(n) for k in (0, 1) for f, n in ((F.min, f"low{k}"), (F.max, f"high{k}"))]
        offers = offers.groupBy("of", "said", "other").agg(*lows)
        fits = asked.join(offers, ["of", "said", "other"]).groupBy("val").agg(*[f(n).alias(n) for n, f in (("low0", F.min), ("high0", F.max), ("low1", F.min), ("high1", F.max))], F.max("strict").alias("strict"))
        only = F.when(F.col("low0") == F.col("high0"), F.col("low0")).when(F.col("low0").isNull() & (~F.col("strict") | (F.col("low1") == F.col("high1"))), F.col("low1"))
        return fits.select("val", only.alias("target")).where("target is not null")

    # contacts first: the entities of short forms and of what they stand for are one
    shorts = beside.where("contact_id is not null").select("val", of.alias("of"), F.explode(F.when(F.col("size") == 2, F.col("longs")).when(F.size("longs") > 0, F.array_union(F.array("reading"), "longs"))).alias("said"), "other", F.lit(False).alias("strict"))
    edges = targets(links, shorts).join(links.where("score >= 2"), "val").select(F.col("contact_id").alias("a"), F.col("target").alias("b")).where("a <> b")
    links = _merged(links, cut(edges))
    edges = targets(links, initial.where("contact_id is not null").drop("contact_id")).join(links.where("score >= 2"), "val").select(F.col("contact_id").alias("a"), F.col("target").alias("b")).where("a <> b")
    links = _merged(links, cut(edges))
    rest = beside.where("contact_id is null").select("val", of.alias("of"), F.explode(F.array_union(F.array("reading"), "longs")).alias("said"), "other", F.lit(True).alias("strict"))
    rest = rest.unionByName(initial.where("contact_id is null").drop("contact_id")).join(links.select("val"), "val", "left_anti")
    return links.unionByName(targets(links, rest).select("val", F.col("target").alias("contact_id"), F.lit(0.5).alias("score")))


def _distant_surnames(whole: DataFrame, linked: DataFrame, found: DataFrame) -> DataFrame:
    """val, contact_id of names whose rare token is two errors away from that of an entity with the same common token.

    Here the common token helps to select: beside it the beginning, the end or an inner
    q-gram of three letters has to be shared. Two errors leave one third of a token of
    nine letters whole. Only tokens written seldom can be such errors.
    """
    inner = lambda c: F.transform(F.sequence(F.lit(2), F.length(c) - 3), lambda i: F.col(c).substr(i, F.lit(3)))
    grams = lambda c: F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), F.substring(c, 1, 3)), F.concat(F.lit("$"), F.substring(c, -3, 3))), inner(c)))
    tasks = _tasks(whole)
    spread = F.array_distinct(F.concat(F.array("b.reading"), F.col("b.longs")))

    def pairs_of(df: DataFrame, most: int, *more: str) -> DataFrame:
        rare = df.select(*more, F.explode(F.filter("all", lambda t: ~t["common"] & (t["freq"] <= most))).alias("r"), F.filter("all", lambda t: t["common"]).alias("beside"))
        wide = rare.select(*more, F.col("r.reading").alias("rare"), F.explode("beside").alias("b"))
        return wide.select(*more, "rare", F.explode(spread).alias("other")).where(F.length("rare") >= 6).distinct()

    book = pairs_of(whole.join(linked.where("score >= 2").select("val", F.col("contact_id").alias("entity")), "val").where("contact_id is not null"), 1 << 62, "entity")
    asked = pairs_of(whole.where("contact_id is null").join(found.select("val"), "val", "left_anti"), SELDOM, "val").join(book.select("rare").distinct(), "rare", "left_anti")
    left = asked.withColumnRenamed("rare", "written").withColumn("gram", F.explode(grams("written"))).repartition(tasks, "other", "gram")
    right = book.withColumn("gram", F.explode(grams("rare"))).repartition(tasks, "other", "gram")
    close_ = (F.abs(F.length("written") - F.length("rare")) <= 2) & (F.levenshtein("written", "rare", 3) >= 0)
    pairs = left.join(right, ["other", "gram"]).where(close_).select("val", "entity", "written", "rare").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(d=[_distance(x, y, 2) for x, y in zip(batch["written"], batch["rare"])])
            yield batch[batch["d"] <= 2][["val", "entity", "d"]].astype({"d": "int32"})

    near = pairs.select("val", "entity", "written", "rare").mapInPandas(verify, "val string, entity bigint, d int")
    best = near.groupBy("val", "entity").agg(F.min("d").alias("d")).groupBy("val").agg(F.min_by("entity", F.struct("d", "entity")).alias("contact_id"), F.min("d").alias("d"), F.collect_set(F.struct("d", "entity")).alias("all"))
    only = F.size(F.filter("all", lambda x: x["d"] == F.col("d"))) == 1
    return best.where(only).select("val", "contact_id")


def _short_surnames(whole: DataFrame, linked: DataFrame) -> DataFrame:
    """val, contact_id of names one of whose tokens is cut to its beginning, found by it and the common token beside it."""
    members = whole.join(linked.where("score >= 2").select("val", F.col("contact_id").alias("entity")), "val").where("contact_id is not null")
    rare = F.filter("all", lambda t: ~t["common"])
    # of names without a rare token, any of them may be what is cut
    cuttable = F.when(F.size(rare) > 0, rare).otherwise(F.col("all"))
    full = members.select("entity", F.explode(cuttable).alias("r"), F.filter("all", lambda t: t["common"]).alias("beside")).select("entity", F.col("r.reading").alias("anchor"), F.explode("beside").alias("b")).where("b.reading <> anchor")
    spread = F.array_distinct(F.concat(F.array("b.reading"), F.col("b.longs")))
    heads = full.select("entity", "anchor", F.explode(spread).alias("other")).distinct()
    heads = heads.where(F.length("anchor") > 3).withColumn("head", F.explode(F.transform(F.sequence(F.lit(3), F.length("anchor") - 1), lambda i: F.col("anchor").substr(F.lit(1), i))))
    heads = heads.groupBy("head", "other").agg(F.min("entity").alias("contact_id"), F.count_distinct("entity").alias("n")).where("n = 1")
    asked = whole.where((F.size("cuts") > 0) & F.col("contact_id").isNull() & (F.size(F.filter("all", lambda t: ~t["common"])) == 0)).join(linked.select("val"), "val", "left_anti")
    asked = asked.select("val", F.explode("cuts").alias("head"), "all")
    asked = asked.select("val", "head", F.explode("all").alias("b")).select("val", "head", F.explode(spread).alias("other")).distinct()
    found = asked.join(heads.select("head", "other", "contact_id"), ["head", "other"]).groupBy("val").agg(F.min("contact_id").alias("contact_id"), F.count_distinct("contact_id").alias("n"))
    return found.where("n = 1").select("val", "contact_id")


def variant_records(contacts: DataFrame, imports: DataFrame, unprocessed: DataFrame, nicknames: DataFrame) -> DataFrame:
    """contact_id, src, row_id of every record that writes the name of an entity otherwise than its first contact does."""
    values = cut(
        packed_values(imports, unprocessed, contacts).select("src", "row_id", "val")
        .unionByName(contacts.select(F.lit("contacts").alias("src"), F.col("contact_id").cast("bigint").alias("row_id"), F.trim("name").alias("val")).where("val is not null"))
        .distinct()
    )
    links = name_links(values, nicknames)
    written = contacts.select(F.col("contact_id").cast("bigint").alias("contact_id"), F.trim("name").alias("name"))
    return values.join(links, "val").join(written, "contact_id").where("val <> name").select("contact_id", "src", "row_id").distinct()
