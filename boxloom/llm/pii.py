"""Personal data: fixed patterns, and terms that give protected entities away.

Base spans are addresses, IP and card numbers and phones. The method is
information-theoretic sanitisation: an entity e is a base span's text; from the
contexts of the corpus p(e), p(t) and p(t, e) of the terms t beside it are
estimated, and t discloses e when PMI(t; e) is at least `alpha` of the
information IC(e) = -log2 p(e) that e itself carries. Such terms are marked in
every document that has e, and generalised (to a name, a number or a term) when
a text is sanitised.

A context is a whole line. A token is a whole address, IP, card
or phone number, or a term: any run of letters and digits, short names too. The
contexts of an entity are those in which it is a token, in lines with a base
span. All four counts are of distinct contexts, and evidence is at least `support` of
them, so that copies of one document prove nothing and hide nothing; an entity
without that many gives no pairs. Pairs and terms are counted before they are
joined.

Everything is built-in expressions. No pattern matches across a line end, so
lines are searched one by one. Positions are running totals of the lengths of
what lies between matches, made by doubling steps, so a text of m matches costs
m log m. The patterns are the contract's, written with possessive repeats and a
start that no earlier failed start can reach, so that long runs cost linear
time and no recursion.

Defined cases: a null text is empty; rows with null or repeated ids give one
row each; an empty table gives an empty result; input columns of any name stay
in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

# Kinds in the order of their rank, with Java patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for any match of a kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# What replaces a span; terms are generalised by their form.
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
TERM = r"[\p{L}\p{N}]++"
#: A token: an address, IP, long number or phone as a whole, or a term. Only starts that no earlier start can reach.
TOKEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|[0-9](?:[\x20-]?[0-9]){13,}+|\+[0-9][\x20().0-9-]+[0-9]|" + TERM
#: What tokens other than terms have.
_OTHER = "[@.+-]|[0-9]{14}"
#: Code points that a substring is searched in; texts are cut into pieces of this size.
_PIECE = 1024


def _q(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def let_sql(value: str, name: str, body: str) -> str:
    """SQL: body with the value bound to a name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sql(items: str, op: str) -> str:
    """SQL: running results of `op` (over x and y) of an array variable, by doubling steps."""
    steps = ", ".join(str(1 << i) for i in range(28))
    return f"aggregate(filter(array({steps}), d -> d < size({items})), {items}, (run, d) -> transform(run, (x, i) -> if(i >= d, {op.replace('y', 'run[i - d]')}, x)))"


_NONE = "filter(array(named_struct('s', 0, 'rank', 0, 'e', 0, 'kind', '', 'x', '')), z -> false)"


def spans_sql(text: str, pattern: str, kind: str, rank: int, ok: str = "true") -> str:
    """SQL: array of struct(s, rank, e, kind, x) of the matches in a text variable that pass `ok` (over y)."""
    each = f"transform(m, (v, j) -> named_struct('s', w[j] - length(v), 'rank', {rank}, 'e', w[j], 'kind', '{kind}', 'x', v))"
    sized = let_sql(f"split({text}, '{_q(pattern)}', -1)", "p", "transform(m, (v, j) -> length(p[j]) + length(v))")
    placed = let_sql(sized, "n", let_sql(running_sql("n", "x + y"), "w", f"filter({each}, y -> {ok})"))
    return let_sql(f"regexp_extract_all({text}, '{_q(pattern)}', 0)", "m", f"if(size(m) = 0, {_NONE}, {placed})")


_LUHN = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, cast(substr(d, -i, 1) AS int), if(cast(substr(d, -i, 1) AS int) > 4, 2 * cast(substr(d, -i, 1) AS int) - 9, 2 * cast(substr(d, -i, 1) AS int)))) % 10 = 0"
# What a match must also be; only the array's first item is looked at, so that numbers of any length are safe.
CHECKS = {
    "email": "true",
    "ip": "forall(transform(split(y.x, '[.]'), q -> ltrim('0', q)), q -> length(q) <= 3 AND coalesce(try_cast(q AS int), 0) <= 255)",
    "card": f"exists(filter(array(translate(y.x, ' -', '')), d -> length(d) BETWEEN 14 AND 19), d -> {_LUHN})",
    "phone": "length(regexp_replace(y.x, '[^0-9]', '')) BETWEEN 10 AND 15",
}


def by_line_sql(text: str, spans: str) -> str:
    """SQL: array of the arrays of spans of each line, placed in the whole text; `spans` is SQL over the variable l."""
    moved = f"transform({spans}, y -> named_struct('s', y.s + at[k] - length(l) - 1, 'rank', y.rank, 'e', y.e + at[k] - length(l) - 1, 'kind', y.kind, 'x', y.x))"
    placed = let_sql("transform(ls, l -> length(l) + 1)", "n", let_sql(running_sql("n", "x + y"), "at", f"transform(ls, (l, k) -> {moved})"))
    return let_sql(f"split({text}, '\n', -1)", "ls", placed)


def line_spans(text: str) -> Column:
    """The base spans of a text column, an array for each line."""
    kinds = [f"if(contains(l, '{NEEDS[k]}'), {spans_sql('l', p, k, i, CHECKS[k])}, {_NONE})" for i, (k, p) in enumerate(PATTERNS.items(), 1)]
    return F.expr(by_line_sql(f"coalesce({text}, '')", f"if(l rlike '[0-9@]', concat({', '.join(kinds)}), {_NONE})"))


def base_spans(text: str) -> Column:
    """Sorted array of the base spans of a text column."""
    return F.array_sort(F.flatten(line_spans(text)))


def _entity(x: str) -> str:
    """SQL: a span's text as it is compared."""
    return f"translate(lower({x}), ' ', '')"


def context(line: str) -> Column:
    """Tokens of a line, lower-cased, joined by spaces."""
    return F.expr(f"array_join(transform(regexp_extract_all(lower({line}), '{_q(TOKEN)}', 0), t -> translate(t, ' ', '')), ' ')")


def terms_of(context: str) -> Column:
    """Distinct terms of a context."""
    return F.expr(let_sql(f"array_distinct(split({context}, ' '))", "t", f"if({context} rlike '{_OTHER}', filter(t, x -> NOT x rlike '{_OTHER}'), t)"))


def entities_of(context: str) -> Column:
    """Distinct entities of a context: tokens that are valid spans."""
    ok = {"email": "contains(y.x, '@')", "ip": "y.x rlike '^[0-9]+[.]'", "card": "y.x rlike '^[0-9-]{14,}$'", "phone": "startswith(y.x, '+')"}
    valid = " OR ".join(f"{ok[k]} AND {CHECKS[k].replace(' -', '-')}" for k in PATTERNS)
    tokens = f"transform(filter(split({context}, ' '), t -> t rlike '{_OTHER}'), t -> named_struct('x', t))"
    return F.expr(f"if({context} rlike '{_OTHER}', array_distinct(transform(filter({tokens}, y -> {valid}), y -> y.x)), array())")


def disclosing(rows: DataFrame, alpha: float = 0.8, support: int = 3) -> DataFrame:
    """(entity, term) of the terms that disclose an entity; rows has text and `lines`, the numbers of lines with spans."""
    held = rows.where("size(lines) > 0").select(F.explode(F.expr(let_sql("split(text, '\\n', -1)", "ls", "transform(lines, n -> ls[n])"))).alias("line"))
    held = materialise(held.select(context("line").alias("context")).distinct().withColumn("c", F.struct(F.xxhash64("context"), F.hash("context"))), "contexts")
    # An entity carries its contexts' hashes only, and rare entities go, before terms are laid out.
    seen = held.select(F.explode(entities_of("context")).alias("entity"), "c")
    often = materialise(seen.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "evidence")
    met = seen.join(often.select("entity"), "entity", "left_semi").join(held, "c")
    both = met.select("entity", F.explode(terms_of("context")).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    both = materialise(both.join(often, "entity"), "pairs")
    if both.isEmpty():
        return both.select("entity", "term")
    # Each term is counted before the wanted ones are picked; the empty term counts the contexts.
    corpus = rows.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").select(context("line").alias("context")).where("context <> ''").distinct()
    counts = corpus.select(F.explode(F.concat(F.array(F.lit("")), terms_of("context"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    wanted = both.select("term").union(both.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    counts = materialise(counts.join(wanted, "term", "left_semi"), "terms")
    n = F.lit(float(counts.where("term = ''").first()["n_t"]))
    # An entity in all contexts carries no information, so nothing discloses it.
    share = F.try_divide(F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t"))), F.log2(n / F.col("n_e")))
    return materialise(both.join(counts, "term").where(share >= alpha).select("entity", "term"), "disclosing")


def find(docs: DataFrame, alpha: float = 0.8, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (struct of all columns), base (spans of the patterns) and spans (with disclosing terms), both sorted."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), line_spans(f"`{text_col}`").alias("found"))
    lines = F.expr("filter(transform(found, (f, i) -> if(size(f) > 0, i, -1)), n -> n >= 0)")
    rows = named.select("doc", F.array_sort(F.flatten("found")).alias("base"), lines.alias("lines"))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "spans")
    rows = rows.withColumn("text", F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")))
    told = disclosing(rows, alpha, support)
    own = rows.where("size(base) > 0").select("rid", F.explode(F.expr(f"array_distinct(transform(base, y -> {_entity('y.x')}))")).alias("entity"))
    own = own.join(told.select("entity").distinct(), "entity", "left_semi")
    # Tokens of the documents that have such an entity, with their places, meet what they disclose.
    tokens = F.expr(f"flatten({by_line_sql('text', spans_sql('l', TOKEN, 'term', 5))})")
    words = rows.where("size(base) > 0").join(own.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(tokens).alias("y"))
    words = words.select("rid", "y", F.lower("y.x").alias("term")).join(told, "term").join(own, ["rid", "entity"], "left_semi")
    marked = words.select("rid", "y").distinct().groupBy("rid").agg(F.collect_list("y").alias("extra"))
    out = rows.drop("lines").join(marked, "rid", "left")
    return out.select("doc", "text", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def span_list(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def count_of(kind: str) -> Column:
    return F.expr(f"size(filter(base, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}")


def replaced(text: str, spans: str) -> Column:
    """A text with its sorted spans replaced by tags; overlapping spans become one, under the first one's tag.

    Substrings are taken from pieces of the text, so none is searched from its start.
    """
    def cut(a: str, b: str) -> str:
        inner = f"substr(ps[k], greatest({a} - k * {_PIECE}, 0) + 1, least({b} - k * {_PIECE}, {_PIECE}) - greatest({a} - k * {_PIECE}, 0))"
        return f"if({b} > {a}, array_join(transform(sequence(cast({a} div {_PIECE} AS int), cast(({b} - 1) div {_PIECE} AS int)), k -> {inner}), ''), '')"

    term = "if(v.x rlike '^[0-9]+$', '[NUMBER]', if(v.x rlike '^\\\\p{Lu}', '[NAME]', '[TERM]'))"
    tag = f"if(v.kind = 'term', {term}, element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in TAGS.items()) + "), v.kind))"
    parts = f"transform({spans}, (v, j) -> {let_sql('if(j = 0, 0, ends[j - 1])', 'b', f'if(v.s >= b, concat({cut('b', 'v.s')}, {tag}), {chr(39) * 2})')})"
    last = let_sql("ends[size(ends) - 1]", "b", cut("b", f"length({text})"))
    whole = let_sql(f"transform({spans}, v -> v.e)", "n", let_sql(running_sql("n", "greatest(x, y)"), "ends", f"concat(array_join({parts}, ''), {last})"))
    return F.expr(f"if(size({spans}) = 0, {text}, {let_sql(f'regexp_extract_all({text}, {chr(39)}(?s).{{1,{_PIECE}}}{chr(39)}, 0)', 'ps', whole)})")


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """docs with every span of `text` replaced by its kind's tag, terms by a more general one."""
    found = find(docs, **params)
    text = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(replaced("text", "spans"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
