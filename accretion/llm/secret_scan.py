"""Secret scans: known formats, and sliding-window Shannon entropy per character class.

Base kinds are patterns: assign, access and hex. The method adds entropy-hex and entropy-base64: candidate strings are
runs of one class's characters with a digit among letters; a window of WINDOW characters slides over each. The counts of
the window's characters are kept in a few long integers, FIELD bits each: the character that leaves and the one that
enters change a count by one each, and the entropy's sum by what their counts contribute. The span reaches from the first
window over the class's threshold to the last. A span of an added kind is suppressed if its whole candidate is a value that
the allow-list has, or if placeholders make up half of the span or more: what merely holds one is still a secret.
DataFrame functions only: positions follow from the lengths of what lies between matches.

Time is linear in a text's length: long candidates are worked through CHUNK windows at a time, and positions are summed up
in groups of matches, so that no array grows match by match over the whole text.

Defined results: null texts are empty, texts may be of any length; spans are in code points, end exclusive; every row
gives a row, repeated ones, too; columns of docs named base and found are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_names


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Kinds in the order of their listing: (kind, pattern, group whose length counts, least length).
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
WINDOW = 20
#: Windows of a candidate, and matches, that are worked through together.
CHUNK, MATCHES = 1024, 512
#: Bits of a count, and counts in a long.
FIELD, FIELDS = 5, 12
#: Sums of n log2 n are whole numbers of this part of a bit, so that they don't drift.
UNIT = 1 << 40
#: (kind, characters of the class, those of which a candidate has one, bits of entropy that a window needs); 20 random
#: characters have about 3.4 and 4.1. What is hexadecimal only is no base64: its class needs fewer bits.
CLASSES = (("entropy-hex", "0-9a-fA-F", "A-Fa-f", 2.9), ("entropy-base64", "A-Za-z0-9+/_=-", "G-Zg-z+/_=-", 3.75))
KINDS = [k[0] for k in (*BASE, *CLASSES)]
#: Placeholders, and public values that look random (digests of nothing, identifiers, a key of documentations).
PLACEHOLDERS = "EXAMPLE(?:KEY)?|example|0123456789(?:abcdef)?|123456789a(?:bcdef)?|abcdef0123|ABCDEF0123|(?:deadbeef|DEADBEEF)+"
PUBLIC = (
    "(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY)",
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
)
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _long_enough(pattern: str, least: int) -> str:
    """For HEX, whose matches are maximal runs, the length can be part of the pattern."""
    return pattern[:-1] + f"{{{least},}}" if pattern == HEX else pattern


def candidate(characters: str, own: str) -> str:
    """Maximal runs of at least WINDOW of a class's characters, with a digit, a letter and one of its own characters."""
    return rf"(?<![{characters}])(?=[{characters}]*[0-9])(?=[{characters}]*[A-Za-z])(?=[{characters}]*[{own}])[{characters}]{{{WINDOW},}}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, however often and within whatever functions of arrays body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(n: Column, size: int) -> Column:
    """0, size, 2 * size, ... below n; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))


def found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of pattern's matches whose group has at least so many characters; SPAN."""
    pat = F.lit(pattern)
    all_, between = F.regexp_extract_all(text, pat, F.lit(0)), F.split(text, pattern)
    rows = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), all_.alias("hit"), (F.regexp_extract_all(text, pat, F.lit(group)) if group else all_).alias("part"))
    size = lambda x: x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    def of_group(g: Column) -> Column:
        return F.aggregate(g["rows"], F.struct(g["at"].alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def spans(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda acc, x: acc + size(x)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        pairs = F.arrays_zip(F.slice(starts, F.lit(1), F.size(groups)).alias("at"), groups.alias("rows"))
        return F.flatten(F.transform(pairs, of_group))

    return _let(_let(rows, lambda r: F.transform(_chunks(F.size(r), MATCHES), lambda i: F.slice(r, i + 1, F.lit(MATCHES)))), spans)


def alphabet(characters: str) -> list[str]:
    return [chr(i) for i in range(128) if re.fullmatch(f"[{characters}]", chr(i))]


def first_hot(value: Column, characters: str, least: float) -> Column:
    """Where the first window of value over the threshold starts, from 0; null if there is none. Nothing after it is looked at."""
    letters = alphabet(characters)
    place = {c: divmod(i, FIELDS) for i, c in enumerate(letters)}
    # of each character: the long that counts it, its field's first bit, and one in that field
    known = [F.struct(F.lit(k).alias("k"), F.lit(FIELD * f).alias("shift"), F.lit(1 << FIELD * f).cast("long").alias("one")) for k, f in (place.get(chr(i), (-1, 0)) for i in range(128))]
    table, absent = F.array(*known), F.struct(F.lit(-1).alias("k"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("one"))
    # the entropy is log2(WINDOW) - sum(n log2 n) / WINDOW
    most = F.lit(round((WINDOW * (math.log2(WINDOW) - least) + 1e-9) * UNIT))
    share = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(WINDOW + 1)]
    # what a count's change from n - 1 to n adds to the sum, at n + 1; nothing for no change at 1
    adds = F.array(*[F.lit(x).cast("long") for x in (0, *(b - a for a, b in zip(share, share[1:], strict=False)))])
    longs = range(-(-len(letters) // FIELDS))

    def count(state: Column, c: Column) -> Column:
        held = F.lit(0).cast("long")
        for k in reversed(longs):
            held = F.when(c["k"] == k, state[f"w{k}"]).otherwise(held)
        return F.call_function("shiftright", held, c["shift"]).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")

    def slide(state: Column, x: Column) -> Column:
        """The character x.old leaves the window, x.new enters it."""
        old, new = x["old"], x["new"]
        same = (old["k"] == new["k"]) & (old["shift"] == new["shift"])
        words = [(state[f"w{k}"] + F.when(new["k"] == k, new["one"]).otherwise(F.lit(0).cast("long")) - F.when(old["k"] == k, old["one"]).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in longs]
        total = F.when(same, state["sum"]).otherwise(state["sum"] + F.element_at(adds, count(state, new) + 2) - F.element_at(adds, count(state, old) + 1))
        first = F.when((state["n"] >= WINDOW) & (state["sum"] <= most), state["n"] - WINDOW)
        return F.when(state["first"].isNotNull(), state).otherwise(F.struct(total.alias("sum"), *words, (state["n"] + 1).alias("n"), first.alias("first")))

    zero = F.struct(F.lit(0).cast("long").alias("sum"), *[F.lit(0).cast("long").alias(f"w{k}") for k in longs], F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"))

    def of_chunk(begin: Column) -> Column:
        # of bytes, which are the characters here: a place in a string is found from its beginning
        text = F.substr(value.cast("binary"), begin + 1, F.lit(CHUNK + WINDOW - 1)).cast("string")
        marks = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.element_at(table, F.ascii(c) + 1))
        pairs = lambda all_: F.transform(all_, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.element_at(all_, i - (WINDOW - 1))).otherwise(absent).alias("old")))
        # a state is judged when the next character comes: one more, of no count, judges the last
        closing = F.array(F.struct(absent.alias("new"), absent.alias("old")))
        return F.aggregate(F.concat(_let(marks, pairs), closing), zero, slide, lambda s: begin + s["first"])

    return F.aggregate(_chunks(F.length(value) - (WINDOW - 1), CHUNK), F.lit(None).cast("int"), lambda acc, begin: F.when(acc.isNotNull(), acc).otherwise(of_chunk(begin)))


def hot_stretch(value: Column, characters: str, least: float) -> Column:
    """struct(first, last): where the first and the last window over the threshold start, from 0; nulls if there is none."""
    last = F.length(value) - WINDOW - first_hot(F.reverse(value), characters, least)
    return _let(first_hot(value, characters, least), lambda first: F.struct(first.alias("first"), F.when(first.isNotNull(), last).alias("last")))


def entropy_spans(text: Column, kind: int, characters: str, own: str, least: float) -> Column:
    # so many bits need so many different characters
    runs = F.filter(found(text, kind, candidate(characters, own), 0, WINDOW), lambda r: F.size(F.array_distinct(F.split(r["value"], ""))) >= math.ceil(2**least))
    measured = F.transform(runs, lambda r: F.struct(r.alias("run"), hot_stretch(r["value"], characters, least).alias("hot")))
    cut = F.transform(
        F.filter(measured, lambda m: m["hot"]["first"].isNotNull()),
        lambda m: F.struct(
            (m["run"]["start"] + m["hot"]["first"]).alias("start"), m["run"]["kind"].alias("kind"), (m["run"]["start"] + m["hot"]["last"] + WINDOW).alias("end"),
            m["run"]["value"].alias("value"), F.substr(m["run"]["value"], m["hot"]["first"] + 1, m["hot"]["last"] + WINDOW - m["hot"]["first"]).alias("hot"),
        ),
    )
    secret = F.filter(cut, lambda s: ~F.rlike(s["value"], F.lit(f"^(?:{'|'.join(PUBLIC)})$")) & (2 * F.length(F.regexp_replace(s["hot"], PLACEHOLDERS, "")) > F.length(s["hot"])))
    return F.transform(secret, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """docs with base and found: spans (start, kind as a place in KINDS, end, value), ascending by start, then kind."""
    docs = docs.drop("base", "found")
    scanned, more = free_names(docs.columns, "scanned", "more")
    text = F.col(scanned)
    docs = docs.withColumn(scanned, F.coalesce("text", F.lit("")))
    none = F.array().cast(SPAN)
    base = F.concat(*[F.when(F.rlike(text, F.lit(_long_enough(p, n))), found(text, i, _long_enough(p, n), g, n)).otherwise(none) for i, (_, p, g, n) in enumerate(BASE)])
    added = F.concat(*[F.when(F.rlike(text, F.lit(candidate(c, own))), entropy_spans(text, len(BASE) + i, c, own, least)).otherwise(none) for i, (_, c, own, least) in enumerate(CLASSES)])
    docs = docs.withColumn("base", F.array_sort(base)).withColumn(more, added)
    return docs.withColumn("found", F.array_sort(F.concat("base", more))).drop(more, scanned)


def listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(result: DataFrame) -> DataFrame:
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return result.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))


def brute_force(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256, spans) by the definitions, in plain Python."""
    text, base, added = text or "", [], []
    for k, (_, pattern, group, least) in enumerate(BASE):
        base += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for k, (_, characters, own, least) in enumerate(CLASSES, len(BASE)):
        for m in re.finditer(f"[{characters}]+", text):
            run = m[0]
            if len(run) < WINDOW or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or not re.search(f"[{own}]", run) or re.fullmatch("|".join(PUBLIC), run):
                continue
            hot = []
            for i in range(len(run) - WINDOW + 1):
                w = run[i : i + WINDOW]
                if -sum(w.count(c) / WINDOW * math.log2(w.count(c) / WINDOW) for c in set(w)) >= least - 1e-9:
                    hot.append(i)
            span = run[hot[0] : hot[-1] + WINDOW] if hot else ""
            if 2 * sum(len(p[0]) for p in re.finditer(PLACEHOLDERS, span)) < len(span):
                added.append((m.start() + hot[0], k, m.start() + hot[-1] + WINDOW))
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, hashlib.sha256(show(base).encode()).hexdigest(), show(base + added))
