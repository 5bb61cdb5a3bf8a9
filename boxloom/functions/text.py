"""Caption and attribute text, as built-in expressions over strings and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that captions and attributes are freed of, headers of answers, and plurals.
SENTENCE_TERMS = ["atmosphere", "lighting", "is no ", "is not ", "are no ", "are not "]
ATTRIBUTE_TERMS = ["atmosphere", "lighting", "background", "noisy caption", "fine-grained caption", "fine grained caption"]
CONDITIONAL_TERMS = ["fine-grained", "fine grained", "noisy"]
PHASE1_HEADER = "Here is the list:"
PHASE2_HEADER = "Here is the list of new elements:"
HUMAN_TERMS = {"men": "man", "women": "woman", "children": "child", "people": "person"}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; plain reuse would repeat its whole expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; a pattern takes ten times as long on short items."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def drop_lead(c: Column) -> Column:
    """The first "this is " anywhere is cut out; with "This is " where the text starts with T."""
    def cut(phrase: str) -> Column:
        at = F.instr(c, phrase)
        return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(phrase), F.length(c)))).otherwise(c)

    return F.when(c.startswith("T"), cut("This is ")).otherwise(cut("this is "))


def drop_final_stop(c: Column) -> Column:
    return F.when(c.endswith("."), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def clean_caption(c: Column, terms: list[str] = SENTENCE_TERMS) -> Column:
    """Lower case, lead and final stop dropped, sentences without the terms joined again; empty if none is left."""
    body = let(let(F.lower(c), drop_lead), drop_final_stop)
    kept = F.filter(F.transform(F.split(body, r"\. "), strip), lambda s: (s != "") & ~reduce(lambda a, b: a | b, [F.contains(s, F.lit(t)) for t in terms]))
    return let(kept, lambda k: F.when(F.size(k) == 0, "").otherwise(F.concat(F.array_join(k, ". "), F.lit("."))))


def drop_parentheses(c: Column) -> Column:
    """Innermost (...) groups go, once."""
    return strip(F.when(F.contains(c, F.lit("(")), F.regexp_replace(c, r"\([^()]*\)", "")).otherwise(c))


def parse_list(answer: Column, header: str) -> Column:
    """A numbered answer as distinct items in order; the first of two or more words of a line always goes."""
    body = F.rtrim(strip(F.replace(answer, F.lit(header), F.lit(""))), F.lit(".,\n "))

    def item(line: Column) -> Column:
        return F.substring(line, F.instr(line, " ") + 1, F.length(line))  # the whole line, if it has no space

    return F.array_distinct(F.filter(F.transform(F.transform(F.split(body, "\n"), strip), item), lambda x: x != ""))


def normalise_attribute(c: Column, drop_commas: bool) -> Column:
    out = F.replace(F.lower(strip(c)), F.lit("_"), F.lit(" "))
    return F.replace(out, F.lit(","), F.lit("")) if drop_commas else out


def filter_attributes(attrs: Column, web: Column | None = None, vlm: Column | None = None) -> Column:
    """Normalised attributes without fixed terms; with captions also without conditional terms that neither holds.

    Terms count inside parentheses too; with captions these go afterwards.
    """
    one = web is not None
    norm = F.transform(attrs, lambda a: normalise_attribute(a, one))
    bad = lambda a: reduce(lambda x, y: x | y, [F.contains(a, F.lit(t)) for t in ATTRIBUTE_TERMS])

    def held(own: Column, body: Column) -> Column:
        out = F.when(bad(body), F.filter(own, lambda a: ~bad(a))).otherwise(own)
        for t in CONDITIONAL_TERMS if one else []:
            out = _drop_unless_held(out, body, t, web, vlm)
        return out

    # Terms are looked for in the whole list first: most lists have none, and their items need not be searched.
    out = let(norm, lambda own: let(F.array_join(own, "\n"), lambda body: held(own, body)))
    if one:
        out = F.transform(out, drop_parentheses)
    return F.filter(out, lambda a: a != "")


def _drop_unless_held(items: Column, body: Column, term: str, web: Column, vlm: Column) -> Column:
    """The captions are searched once a list, not once an item, and only if the list's text has the term."""
    absent = F.contains(body, F.lit(term)) & F.coalesce(~F.contains(web, F.lit(term)) & ~F.contains(vlm, F.lit(term)), F.lit(True))
    return let(items, lambda own: F.when(absent, F.filter(own, lambda a: ~F.contains(a, F.lit(term)))).otherwise(own))


def join_list(a: Column) -> Column:
    return F.array_join(a, ", ")


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def words(c: Column) -> Column:
    """Distinct words after hyphens became spaces."""
    return F.array_distinct(F.split(F.replace(c, F.lit("-"), F.lit(" ")), " "))


def strip_plurals(items: Column) -> Column:
    """Of distinct items those go that are another item (not yet gone) and an s, and blank ones."""
    stem = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)

    def settle(known: Column) -> Column:
        ending = F.filter(known, lambda x: x.endswith("s"))
        held = F.array_intersect(F.transform(ending, stem), known)  # hashed: a list is not searched once an item
        # An s alone also goes once any item is gone, as that leaves a blank.
        maybe = let(held, lambda h: F.filter(ending, lambda x: F.array_contains(h, stem(x)) | (x == "s")))
        goes = lambda gone, x: F.when(x == "s", F.array_contains(known, "") | (F.size(gone) > 0)).otherwise(~F.array_contains(gone, stem(x)))
        gone = F.aggregate(maybe, F.slice(known, 1, 0), lambda gone, x: F.when(goes(gone, x), F.concat(gone, F.array(x))).otherwise(gone))
        return F.array_except(known, F.concat(gone, F.array(F.lit(""))))

    return let(items, settle)


def map_humans(items: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HUMAN_TERMS.items() for x in kv])
    return F.array_distinct(F.transform(items, lambda x: F.coalesce(table[x], x)))


def word_in(word: str, phrase: Column) -> Column:
    """Whole word inside a longer phrase."""
    return phrase.startswith(word + " ") | phrase.endswith(" " + word) | F.contains(phrase, F.lit(f" {word} "))


def add_singulars(items: Column) -> Column:
    """man, woman, child, person are added when only longer phrases hold them or their plural."""
    def added(own: Column, phrases: Column) -> Column:
        for plural, singular in HUMAN_TERMS.items():
            own = _add_if_inside(own, phrases, plural, singular)
        return own

    return let(items, lambda own: let(F.filter(own, lambda x: F.contains(x, F.lit(" "))), lambda phrases: added(own, phrases)))


def _add_if_inside(items: Column, phrases: Column, plural: str, singular: str) -> Column:
    def add(known: Column) -> Column:
        missing = ~F.array_contains(known, singular) & F.exists(phrases, lambda p: word_in(plural, p) | word_in(singular, p))
        return F.when(missing, F.concat(known, F.array(F.lit(singular)))).otherwise(known)

    return let(items, add)


def by_length(items: Column) -> Column:
    keyed = F.sort_array(F.transform(items, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def short_items(items: Column) -> Column:
    """Items of at most four words, hyphens taken as spaces."""
    ends = lambda a: F.length(a) - F.length(F.replace(F.replace(a, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")))
    return F.filter(items, lambda a: ends(a) <= 3)


def settle_attributes(unlike: Column, phase2: Column) -> Column:
    """The final list: phase-1 items without later ones like them, phase 2, plurals and human terms settled, shortest first."""
    settled = let(F.array_union(unlike, phase2), lambda b: F.when(F.size(b) > 0, strip_plurals(b)).otherwise(b))
    return by_length(add_singulars(map_humans(settled)))


def display_caption(c: Column) -> Column:
    body = F.when(c.startswith("This is "), F.substring(c, F.lit(9), F.length(c))).otherwise(c)
    return F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))


def make_key(key: Column, replica: Column) -> Column:
    return F.concat_ws("_", key, replica.cast("string"))


def split_key(c: Column) -> tuple[Column, Column]:
    """(key, replica) of a joined key; replicas of any number of digits."""
    return F.regexp_extract(c, r"^(.*)_(\d+)$", 1), F.regexp_extract(c, r"^(.*)_(\d+)$", 2).cast("int")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def folder(path: Column, up: int = 1) -> Column:
    return F.regexp_replace(path, r"(?:/[^/]*){%d}$" % up, "")


def last_sentence_within(c: Column, limit: int = 77) -> Column:
    """Where, in code points, the last sentence ends that ends within `limit` words; 0 if none does.

    A sentence ends with a word that ends in . ! or ?, and with the text.
    """
    def ends(pieces: Column) -> Column:
        step = lambda a, w: F.struct(
            (a["n"] + 1).alias("n"),
            (a["at"] + F.length(w)).alias("at"),
            F.when(w.rlike("[.!?]$") | (a["n"] + 1 == F.size(pieces)), a["at"] + F.length(w)).otherwise(a["best"]).alias("best"),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("best"))
        return F.aggregate(F.slice(pieces, 1, limit), start, step, lambda a: a["best"])

    return let(F.regexp_extract_all(c, F.lit(r"\s*\S+"), F.lit(0)), ends)
