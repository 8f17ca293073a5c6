"""License scans by ordered signature rules, in DataFrame expressions only.

A text is first held against one expression of gate words; every rule needs one of them, so texts without any are done.
The others are written as words (lower case, one space between) and held against the rules whose keyword they contain.
Each match becomes an interval of words with the rule's priority. Of two matches of which one contains the other, the one
of weaker priority is suppressed, and of equal priorities the shorter one (of equal intervals the later rule's); matches
that only overlap both stay. Labels are those of the intervals left, and those of the base phrases, which are never suppressed.

The rules are written as families: a name, its versions, and the forms in which licenses are cited. Together they give
some hundreds of expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import ascii_lower, fresh

#: What separates words once A-Z are lowered, and what makes up a word before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, long name (an expression over words), short names, versions. A version "2 0" is the words of "2.0".
VERSIONED = (
    ("apache", r"apache(?: software)?(?: foundation)?", ("apache", "asl"), ("1 0", "1 1", "2 0")),
    ("gpl", r"gnu general public", ("gpl", "gnu gpl"), ("1 0", "2 0", "3 0")),
    ("lgpl", r"gnu (?:lesser|library) general public", ("lgpl", "gnu lgpl"), ("2 0", "2 1", "3 0")),
    ("agpl", r"(?:gnu )?affero general public", ("agpl", "gnu agpl"), ("1 0", "3 0")),
    ("fdl", r"gnu free documentation", ("gfdl", "gnu fdl"), ("1 1", "1 2", "1 3")),
    ("mpl", r"mozilla public", ("mpl", "mozilla"), ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public", ("epl", "eclipse"), ("1 0", "2 0")),
    ("cddl", r"common development and distribution", ("cddl",), ("1 0", "1 1")),
    ("cpl", r"common public", ("cpl",), ("1 0",)),
    ("osl", r"open software", ("osl",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", r"academic free", ("afl",), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", r"(?:perl )?artistic", ("artistic",), ("1 0", "2 0")),
    ("boost", r"boost software", ("bsl", "boost"), ("1 0",)),
    ("eupl", r"european union public", ("eupl",), ("1 0", "1 1", "1 2")),
    ("ms-pl", r"microsoft public", ("ms pl", "mspl"), ("1 0",)),
    ("ms-rl", r"microsoft reciprocal", ("ms rl", "msrl"), ("1 0",)),
    ("odbl", r"open (?:data commons open )?database", ("odbl",), ("1 0",)),
    ("python", r"python software foundation", ("psf",), ("2 0", "3 0")),
    ("php", r"php", ("php",), ("3 0", "3 01")),
    ("zope", r"zope public", ("zpl",), ("1 1", "2 0", "2 1")),
    ("lppl", r"latex project public", ("lppl",), ("1 0", "1 2", "1 3")),
    ("ofl", r"sil open font", ("ofl",), ("1 0", "1 1")),
    ("ecl", r"educational community", ("ecl",), ("1 0", "2 0")),
    ("sspl", r"server side public", ("sspl",), ("1 0",)),
    ("cecill", r"cecill", ("cecill",), ("1 0", "2 0", "2 1")),
)
#: Creative Commons: clause codes with their long wording; versions.
CLAUSES = (
    ("by-nc-sa", r"attribution non ?commercial share ?alike"), ("by-nc-nd", r"attribution non ?commercial no ?deriv\S*"), ("by-nc", r"attribution non ?commercial"),
    ("by-sa", r"attribution share ?alike"), ("by-nd", r"attribution no ?deriv\S*"), ("by", r"attribution"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: label, a keyword that every match contains, and an expression that needs no version.
PLAIN = (
    ("mit", "licen", r"(?:mit|expat|x11) licen[cs]ed?(?: terms)?"), ("mit", "licen", r"licen[cs]ed? (?:under|with) (?:the )?(?:terms of the )?(?:mit|expat)"), ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files?)?|(?: \S+){0,40}? licen[cs]e)"),
    ("bsd", "bsd", r"bsd(?: style| like)? licen[cs]ed?"), ("bsd-0", "bsd", r"(?:0|zero) clause bsd(?: licen[cs]e)?|0bsd licen[cs]e"),
    ("bsd-2", "licen", r"(?:2|two) clause licen[cs]e"), ("bsd-2", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e|bsd 2 clause licen[cs]e"),
    ("bsd-3", "licen", r"(?:3|three) clause licen[cs]e"), ("bsd-3", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e|bsd 3 clause licen[cs]e"),
    ("bsd-4", "licen", r"(?:4|four) clause licen[cs]e"), ("bsd-4", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|(?:old|original) bsd licen[cs]e|bsd 4 clause licen[cs]e"),
    ("isc", "licen", r"isc licen[cs]ed?"), ("zlib", "licen", r"zlib(?: libpng)? licen[cs]ed?"), ("unlicense", "licen", r"(?:the )?unlicen[cs]e"), ("wtfpl", "licen", r"do what the \S+ you want to public licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"), ("cc0", "commons", r"creative commons (?:zero|cc0)(?: 1 0)?"), ("cc-by", "commons", r"creative commons licen[cs]ed?"), ("public-domain", "domain", r"(?:dedicated to|placed (?:in|into)|released (?:in|into)|in) the public domain"),
    ("openssl", "licen", r"openssl licen[cs]e"), ("ruby", "licen", r"ruby licen[cs]e"), ("vim", "licen", r"vim licen[cs]e"), ("beerware", "licen", r"beerware licen[cs]e|beer ware licen[cs]e"), ("postgresql", "licen", r"postgresql licen[cs]e"), ("ncsa", "licen", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("curl", "licen", r"curl licen[cs]e"), ("json", "licen", r"json licen[cs]e"), ("icu", "licen", r"icu licen[cs]e"), ("unicode", "licen", r"unicode(?: inc)? licen[cs]e(?: agreement)?"), ("proprietary", "rights", r"all rights reserved"), ("proprietary", "licen", r"proprietary licen[cs]e|commercial licen[cs]e"),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: \d\d\d\d)*"), ("unknown-license", "licen", r"(?:released|licen[cs]ed|distributed|available|published) under (?:the |an? )?(?:\S+ ){1,6}?licen[cs]e(?:(?: version)? v?\d+(?: \d+)?)?"), ("unknown-license", "licen", r"terms (?:and conditions )?of (?:the|this|an?) (?:\S+ ){0,6}?licen[cs]e(?:(?: version)? v?\d+(?: \d+)?)?"), ("unknown-license", "licen", r"see (?:the )?licen[cs]e(?: file)?"),
)

#: A separator in a text as it is written.
SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: One of these is in every text that a rule or base phrase can match: a word that the rule can't do without, or a short
#: name with the first digit of its version. Separators vary.
SHORT_NAMES = "|".join(s.replace(" ", f"{SEP}+") for *_, shorts, _ in VERSIONED for s in shorts)
GATE = rf"(?i)licen[cs]|copyright|commons|domain|rights|cc0|clause{SEP}+bsd|hereby{SEP}+granted|(?<![0-9a-z])(?:cc{SEP}+by|(?:{SHORT_NAMES})(?:{SEP}+version|{SEP}*v)?{SEP}*[0-9])"


def versions(v: str) -> str:
    """An expression for a version's words: 2.0 is also cited as 2."""
    major, _, minor = v.partition(" ")
    return rf"{major}(?: 0)?" if minor == "0" else rf"{major} {minor}"


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, expression over words, score); the lower a priority the stronger. In order."""
    out = [(0, label, phrase.split()[0] if phrase.startswith("cc") else "license", phrase, 1.0) for phrase, label in BASE]
    lic = r"licen[cs]ed?"
    for name, long, shorts, vs in VERSIONED:
        key = long.split()[-1].strip("()?") if long.isalpha() else {"apache": "apache", "lgpl": "general public", "agpl": "affero", "artistic": "artistic", "odbl": "database"}.get(name, long)
        for v in vs:
            label = f"{name}-{v.replace(' 0', '').replace(' ', '.')}"
            ver = versions(v)
            out.append((1, f"{label}-or-later", key, rf"{long} {lic}(?: version| v)? ?{ver} or(?: \(?at your option\)?)?(?: any)? later(?: version)?", 0.95))
            out.append((1, f"{label}-only", key, rf"{long} {lic}(?: version| v)? ?{ver} only", 0.95))
            out.append((2, label, key, rf"{long} {lic}(?: version| v)? ?{ver}", 0.9))
            for s in shorts:
                out.append((3, label, s, rf"{s}(?: {lic})?(?: version| v|v)? ?{ver}(?: {lic})?" if s not in ("apache", "mozilla", "eclipse", "artistic", "php", "boost") else rf"{s} {lic} ?{ver}", 0.8))
        out.append((4, name, key, rf"{long} {lic}", 0.6))
    for code, words in CLAUSES:
        short = code.replace("-", " ")
        for v in CC_VERSIONS:
            label = f"cc-{code}-{v.replace(' ', '.')}"
            out.append((1, label, "commons", rf"creative commons {words} {v}(?: \S+)?(?: international| unported| generic)?(?: {lic})?", 0.95))
            out.append((2, label, "cc", rf"cc {short} {versions(v)}", 0.9))
        out.append((3, f"cc-{code}", "commons", rf"creative commons {words}(?: {lic})?", 0.8))
        out.append((4, f"cc-{code}", "cc", rf"cc {short}", 0.7))
    for label, keyword, rx in PLAIN:
        out.append((6 if label in ("unknown-license", "copyright") else 5, label, keyword, rx, 0.3 if label in ("unknown-license", "copyright") else 0.7))
    return out


#: Between a word's number and the word itself where both are written; no word holds it.
MARK = "\x01"


def numbered(expression: str) -> str:
    """A rule's expression over words, for words that have their numbers before them."""
    gap = rf" \d++{MARK}"
    return re.sub(r" (\??)", lambda m: f"(?:{gap})?" if m[1] else gap, expression)


FOUND = "array<struct<first:int,past:int,priority:int,rank:int,label:string,score:double>>"
#: Priorities of rules.
LEVELS = 7


def hits(plain: str, words: str) -> Column:
    """All rules' matches in a column of words with numbers. A rule is only tried where its keyword is in the plain words,
    and its expression is compiled once for a task."""
    known = rules()
    groups: dict[str, list[str]] = {}
    for rank, (_, _, keyword, rx, _) in enumerate(known):
        groups.setdefault(keyword, []).append(rf"named_struct('rank', {rank}, 'm', regexp_extract_all(`{words}`, r'(?<= )\d++{MARK}(?:{numbered(rx)})(?= )', 0))")
    tried = F.flatten(F.array(*[F.expr(f"CASE WHEN contains(`{plain}`, '{k}') THEN array({', '.join(g)}) ELSE array() END") for k, g in groups.items()]))
    number = lambda m, a: F.substring_index(F.substring_index(m, " ", a), MARK, 1).cast("int")
    table = F.lit([p for p, *_ in known]), F.lit([label for _, label, *_ in known]), F.lit([v for *_, v in known])

    def of_rule(r: Column) -> Column:
        priority, label, score = (F.get(t, r["rank"]) for t in table)
        return F.transform(r.m, lambda m: F.struct(number(m, 1).alias("first"), (number(m, -1) + 1).alias("past"), priority.alias("priority"), r["rank"].alias("rank"), label.alias("label"), score.alias("score")))

    return F.flatten(F.transform(tried, of_rule))


def fold(found: Column, start: int, stays: Callable[[Column, Column], Column], reached: Callable[..., Column]) -> Column:
    """Those of found that stay, by how far each priority has reached before them.

    Folded in blocks of about the root of their number: what each block reaches alone, then what lies before each block, then
    the blocks themselves. So what is copied grows with the number to the power 1.5 at most.
    """
    begin = F.array(*[F.lit(start)] * LEVELS)
    further = lambda reach, d: F.transform(reach, lambda r, i: F.when(i == d.priority, reached(r, d.past)).otherwise(r))

    def within(block: Column, reach: Column) -> Column:
        step = lambda a, d: F.struct(further(a.reach, d).alias("reach"), F.when(stays(a.reach, d), F.concat(a.out, F.array(d))).otherwise(a.out).alias("out"))
        return F.aggregate(block, F.struct(reach.alias("reach"), F.array().cast(FOUND).alias("out")), step, lambda a: a.out)

    def blocked(f: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(f))).cast("int"))
        blocks = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / n).cast("int")), lambda b: F.slice(f, b * n + 1, n)))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        alone = F.transform(blocks, lambda b: F.aggregate(b, begin, further))
        nothing = F.struct(begin.alias("reach"), F.array().cast("array<array<int>>").alias("out"))
        before = F.aggregate(alone, nothing, lambda a, r: F.struct(F.zip_with(a.reach, r, lambda x, y: reached(x, y)).alias("reach"), F.concat(a.out, F.array(a.reach)).alias("out")), lambda a: a.out)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), before.alias("reach")), lambda z: within(z.block, z.reach)))

    return F.when(F.size(found) > 64, let(found, blocked)).otherwise(within(found, begin))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``found``: all matches, in order of (first word, longest, priority, rule), and ``kept``: those left.

    Both are arrays of (first, past, priority, rank, label, score); rank 0 to 2 are the base phrases. A null or empty
    text has none, equal texts have the same. Columns of these names are replaced, all others pass unchanged. A narrow step.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = F.when(raw.rlike(GATE), F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(raw), SEPARATORS, " ")), F.lit(" ")))
    docs = docs.drop("found", "kept")
    names = fresh(docs, "words", "numbered")
    docs = docs.withColumn(names[0], plain)
    w = F.col(names[0])
    docs = docs.withColumn(names[1], F.concat(F.lit(" "), F.array_join(F.transform(F.split(F.trim(w), " "), lambda x, i: F.concat(i.cast("string"), F.lit(MARK), x)), " "), F.lit(" ")))
    docs = docs.withColumn("found", F.when(w.isNotNull(), hits(*names).cast(FOUND)).otherwise(F.array().cast(FOUND)))
    ordered = F.transform(F.array_sort(F.transform("found", lambda d: F.struct(d["first"].alias("a"), (-d.past).alias("b"), d.priority.alias("c"), d["rank"].alias("d"), d.alias("e")))), lambda x: x.e)
    docs = docs.withColumn("found", F.when(F.size("found") > 1, ordered).otherwise(F.col("found")))
    # Whatever contains an interval comes before it and what it contains comes after, so one fold each way does, which
    # needs only how far each priority has reached.
    inside = fold(F.col("found"), -1, lambda reach, d: ~F.exists(F.slice(reach, 1, d.priority + 1), lambda r: r >= d.past), F.greatest)
    around = lambda found: F.reverse(fold(F.reverse(found), 2**31 - 1, lambda reach, d: (d.priority == 0) | ~F.exists(F.slice(reach, 1, F.greatest(d.priority, F.lit(1))), lambda r: r <= d.past), F.least))
    docs = docs.withColumn("kept", F.when(F.size("found") > 1, inside).otherwise(F.col("found")))
    return docs.withColumn("kept", F.when(F.size("kept") > 1, around(F.col("kept"))).otherwise(F.col("kept"))).drop(*names)


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, places of base phrases, labels, score (the best of the matches left, else 0).

    A null or empty text has no words, no places (first_word and last_word null), empty labels and the score 0. Other
    columns are ignored.
    """
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = detect(slim).withColumn("base", F.filter("found", lambda x: x["rank"] < len(BASE)))
    labels = lambda c: F.transform(c, lambda x: x.label)
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    first = F.transform("base", lambda x: x["first"])
    return d.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"), said(labels("base")).alias("base_labels"), said(F.concat(labels("base"), labels("kept"))).alias("labels"), F.coalesce(F.array_max(F.transform("kept", lambda x: x.score)), F.lit(0.0)).alias("score"))
