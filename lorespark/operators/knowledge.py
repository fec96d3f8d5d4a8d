"""Mining concepts, claims, relations, tags and sources from texts.

All per-document work is keyed by the document id behind one exchange, or
stays inside the document's row; only small keys cross documents, and those
global first-wins merges are map-side aggregates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lorespark.functions import rules, text as tx
from lorespark.functions.ordered import first_arrivals
from lorespark.operators import search
from lorespark.operators.chunking import let
from lorespark.operators.sections import LINE_BREAK
from lorespark.session import prepare

_W = tx.WORD
_WORD_END = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_SPOKEN_WORD = rf"({_W}(?:[\p{{L}}\p{{N}}_'-]*{_W})?)"
_TERM = rf"(?<!{_W})([A-Za-z][A-Za-z'-]{{2,}}{_WORD_END})"
# fixed values: what counts as a capitalised word and as a term
_CAPS = r"(?:[A-Z]{2,}|[A-Z][a-z]+)"
_PHRASE = rf"(?<!{_W})({_CAPS}(?:{tx.SPACE}+{_CAPS}){{0,3}})(?!{_W})"
_EDGE_MARKS = r"""^[.,:;!?()\[\]{}"']+|[.,:;!?()\[\]{}"']+$"""


# --- sentences -------------------------------------------------------------------


def _heading_like(line: Column) -> Column:
    def by_words(plain: Column, words: Column) -> Column:
        n = F.size(words)
        titled = F.size(
            F.filter(
                words,
                lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
                | (w.rlike(r"^\p{Lu}[^\p{Lu}\p{Lt}]*$") & w.rlike(r"\p{Ll}")),
            )
        )
        return (
            (n == 0)
            | ((n <= 10) & F.endswith(plain, F.lit(":")))
            | ((n <= 8) & ~plain.rlike(r"[.!?]$") & (titled >= 0.75 * n))
        )

    plain = tx.strip(F.regexp_replace(line, rf"^(?:[#>*]|{tx.SPACE})+", ""))
    # every value is bound once: expressions inside array functions are not shared;
    # a line of more words than any heading has is not cut into words
    return F.startswith(line, F.lit("#")) | let(
        plain,
        lambda p: ~_has_words(p, 11) & let(F.regexp_extract_all(p, F.lit(_SPOKEN_WORD), 1), lambda w: by_words(p, w)),
    )


def _has_words(text: Column, least: int) -> Column:
    """Whether a text has so many spoken words; reads no further than that."""
    return text.rlike(rf"^{tx.NON_WORD}*+(?:(?>{_SPOKEN_WORD}){tx.NON_WORD}*+){{{least}}}")


def sentence_array(text: Column, min_words: int = 5, min_chars: int = 25) -> Column:
    """Informative sentences of a text, in order: headings and bullets removed."""
    lines = F.transform(F.split(text, LINE_BREAK), tx.collapse_space)
    lines = F.filter(lines, lambda x: (x != "") & ~_heading_like(x))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, rf"^(?:[-*+]|\p{{Nd}}+[.)]){tx.SPACE}+", ""))
    parts = F.flatten(F.transform(bare, lambda x: F.split(x, rf"(?<=[.!?]){tx.SPACE}+")))
    # parts of a collapsed line have even space
    return F.filter(parts, lambda s: (F.length(s) >= min_chars) & _has_words(s, min_words))


def sentences(docs: DataFrame, id_col: str, text: str, min_words: int = 5, min_chars: int = 25) -> DataFrame:
    """(id, pos, sentence); narrow, no shuffle."""
    return docs.select(
        id_col,
        F.posexplode(sentence_array(tx.nfkc(F.col(text)), min_words, min_chars)).alias("pos", "sentence"),
    )


# --- concept candidates ------------------------------------------------------------


def dictionary_matches(
    docs: DataFrame, id_col: str, text: str,
    concepts: Mapping[str, Sequence[str]] = rules.KNOWN_CONCEPTS,
) -> DataFrame:
    """(id, place, title, n): whole-term alias occurrences per known concept."""
    # lowered once: generators do not share common subexpressions
    rows = docs.select(id_col, text, F.lower(text).alias("__low"))
    found = _dictionary(F.col(text), F.col("__low"), concepts)
    return rows.select(id_col, F.explode(found).alias("m")).select(id_col, "m.*").filter("n > 0")


def _dictionary(text: Column, lowered: Column, concepts: Mapping[str, Sequence[str]]) -> Column:
    """Array of (place, title, n), a concept each."""

    def among(words: Column, alias: str) -> Column:
        return F.size(F.filter(words, lambda w: w.rlike(rf"(?iu)^{alias}\z")))

    def hits(aliases: Sequence[str], words: Column) -> Column:
        # the cheap literal test spares the pattern scan of most texts
        counts = [
            among(words, a) if a in plain
            else F.when(F.contains(lowered, F.lit(a.lower())), F.regexp_count(text, F.lit(tx.term_pattern(a)))).otherwise(0)
            for a in aliases
        ]
        return sum(counts[1:], counts[0])

    # whole terms that are one word cannot overlap, so one scan finds all of them
    plain = sorted({a for al in concepts.values() for a in al if re.fullmatch(r"\w+", a)})
    scan = rf"(?iu)(?<!{_W})({'|'.join(plain)})(?!{_W})" if plain else r"(\A\b\B)"
    return let(
        F.regexp_extract_all(text, F.lit(scan), 1),
        lambda words: F.array(*[
            F.struct(F.lit(i).alias("place"), F.lit(title).alias("title"), hits(aliases, words).cast("bigint").alias("n"))
            for i, (title, aliases) in enumerate(concepts.items())
        ]),
    )


def terms(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, term): lower-cased word tokens in order."""
    return docs.select(
        id_col, F.posexplode(F.regexp_extract_all(text, F.lit(_TERM), 1)).alias("pos", "raw")
    ).select(id_col, "pos", F.lower("raw").alias("term"))


def term_counts(tokens: DataFrame, id_col: str) -> DataFrame:
    return tokens.groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )


def title_case(term: Column) -> Column:
    """Capital after every apostrophe and hyphen as well."""
    return F.array_join(F.transform(F.split(term, "(?<=['-])"), F.initcap), "")


def _drop_leading_stopwords(value: Column, stopwords: Sequence[str]) -> Column:
    words = "|".join(stopwords)
    return F.regexp_replace(value, rf"(?i)^(?:(?:{words})(?: |$))+", "")


def phrases(
    docs: DataFrame, counts: DataFrame, id_col: str, text: str,
    stopwords: Sequence[str] = rules.STOPWORDS,
) -> DataFrame:
    """(id, place, title): capitalised phrases; a lone plain word must recur."""
    found = docs.select(
        id_col, F.posexplode(F.regexp_extract_all(text, F.lit(_PHRASE), 1)).alias("place", "raw")
    )
    title = _drop_leading_stopwords(tx.collapse_space(F.col("raw")), stopwords)
    found = found.select(id_col, "place", title.alias("title")).filter("title <> ''")
    seen = counts.select(id_col, F.col("term").alias("__t"), "n")
    joined = found.withColumn("__t", F.lower("title")).join(seen, [id_col, "__t"], "left")
    single = ~F.contains("title", F.lit(" "))
    acronym = ~F.col("title").rlike("[a-z]")
    return joined.filter(~single | acronym | (F.coalesce("n", F.lit(0)) >= 2)).select(
        id_col, "place", "title"
    )


def frequent_terms(
    counts: DataFrame, id_col: str, stopwords: Sequence[str] = rules.STOPWORDS, top: int | None = None
) -> DataFrame:
    """(id, place, title): frequent terms; ties keep first occurrence order.

    All of them, unless the caller asks for the ``top`` ones.
    """
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "first_pos")
    kept = counts.filter(
        (F.col("n") >= 3) & (F.length("term") >= 4) & ~F.col("term").isin(list(stopwords))
    )
    ranked = kept.withColumn("place", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("place") <= top)
    return ranked.select(id_col, "place", title_case(F.col("term")).alias("title"))


def bigrams(
    tokens: DataFrame, id_col: str, stopwords: Sequence[str] = rules.STOPWORDS
) -> DataFrame:
    """(id, place, title, n): adjacent term pairs seen at least twice."""
    order = Window.partitionBy(id_col).orderBy("pos")
    pairs = tokens.withColumn("second", F.lead("term").over(order)).filter("second IS NOT NULL")
    counts = pairs.groupBy(id_col, "term", "second").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )
    stop = list(stopwords)
    kept = counts.filter((F.col("n") >= 2) & ~F.col("term").isin(stop) & ~F.col("second").isin(stop))
    ranked = kept.withColumn(
        "place", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first_pos"))
    )
    title = F.concat_ws(" ", title_case(F.col("term")), title_case(F.col("second")))
    return ranked.select(id_col, "place", title.alias("title"), "n")


_REPEATS = T.StructType([
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType())),
    T.StructField("first", T.ArrayType(T.StringType())), T.StructField("second", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_REPEATS)
def _repeats(words: pd.Series) -> pd.DataFrame:
    """Terms and neighbouring pairs seen twice or more, by count, then first place."""

    def repeated(items) -> list:
        # counts keep the order of first places, and so does the sort
        kept = [x for x in Counter(items).items() if x[1] > 1]
        return sorted(kept, key=lambda x: -x[1])

    def row(found) -> tuple:
        low = [w.lower() for w in found] if found is not None else []
        one, two = repeated(low), repeated(zip(low, low[1:]))
        return [w for w, _ in one], [n for _, n in one], [p[0] for p, _ in two], [p[1] for p, _ in two]

    return pd.DataFrame([row(x) for x in words], columns=_REPEATS.names)


def _exploded(items: str | Column) -> Column:
    """An outer explode: a plain one tests its array first, and so makes it twice."""
    return F.explode_outer(items)


def with_candidates(
    docs: DataFrame, id_col: str, text: str,
    concepts: Mapping[str, Sequence[str]] = rules.KNOWN_CONCEPTS,
    stopwords: Sequence[str] = rules.STOPWORDS,
    cap: int | None = None,
) -> DataFrame:
    """Documents with ``found``: an array of (rank, title, key), and ``raw_titles``.

    Dictionary hits, phrases, terms and bigrams in this order; aliases become
    canonical titles and keys are unique. All titles are kept, ranked; a
    caller that wants the first ones only passes ``cap``. Narrow, no shuffle:
    everything about a document comes from its own row.
    """
    prepare(docs.sparkSession)
    stop = list(stopwords)
    one = F.lit(1).cast("bigint")
    rows = docs.withColumns({
        "__raw": F.regexp_extract_all(text, F.lit(_PHRASE), 1), "__low": F.lower(text),
        "__r": _repeats(F.regexp_extract_all(text, F.lit(_TERM), 1)),
    })
    item = lambda title, weight=one: F.struct(title.alias("title"), weight.alias("weight"))

    def telling(title: Column) -> Column:
        acronym = ~title.rlike("[a-z]")
        return (title != "") & (F.contains(title, F.lit(" ")) | acronym | F.array_contains("__r.terms", F.lower(title)))

    known = F.filter(_dictionary(F.col(text), F.col("__low"), concepts), lambda m: m["n"] > 0)
    phrase = F.transform("__raw", lambda x: _drop_leading_stopwords(tx.collapse_space(x), stop))
    term = F.filter(
        F.arrays_zip(F.col("__r.terms").alias("t"), F.col("__r.n").alias("n")),
        lambda x: (x["n"] >= 3) & (F.length(x["t"]) >= 4) & ~x["t"].isin(stop),
    )
    pair = F.filter(
        F.arrays_zip(F.col("__r.first").alias("a"), F.col("__r.second").alias("b")),
        lambda x: ~x["a"].isin(stop) & ~x["b"].isin(stop),
    )
    raw = F.concat(
        F.transform(known, lambda m: item(m["title"], m["n"])),
        F.transform(F.filter(phrase, telling), lambda x: item(x)),
        F.transform(term, lambda x: item(title_case(x["t"]))),
        F.transform(pair, lambda x: item(F.concat_ws(" ", title_case(x["a"]), title_case(x["b"])))),
    )
    canonical = {a.casefold().replace("-", " "): t for t, al in concepts.items() for a in (t, *al)}
    table = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])

    def clean(r: Column) -> Column:
        title = _drop_leading_stopwords(F.regexp_replace(tx.collapse_space(r["title"]), _EDGE_MARKS, ""), stop)
        return let(title, lambda t: F.struct(t.alias("title"), tx.key_of(t).alias("key"), r["weight"].alias("weight")))

    def named(r: Column) -> Column:
        title = table[r["key"]]
        return F.when(title.isNull(), r).otherwise(
            F.struct(title.alias("title"), tx.key_of(title).alias("key"), r["weight"].alias("weight")))

    def merged(keys: Column, titles: Column) -> Column:
        unique = F.array_distinct(keys) if cap is None else F.slice(F.array_distinct(keys), 1, cap)
        return F.transform(unique, lambda k, i: F.struct(
            (i + 1).alias("rank"), F.get(titles, (F.array_position(keys, k) - 1).cast("int")).alias("title"), k.alias("key")))

    kept = F.filter(F.transform(raw, clean), lambda r: (F.length(r["key"]) >= 3) & ~r["key"].isin(stop))
    made = let(F.transform(kept, named), lambda x: F.struct(
        let(x["key"], lambda keys: let(x["title"], lambda titles: merged(keys, titles))).alias("found"),
        F.aggregate(x["weight"], F.lit(0).cast("bigint"), lambda a, w: a + w).alias("raw_titles"),
        F.size(F.array_distinct(x["key"])).alias("n"),
    ))
    rows = rows.withColumn("__m", made)
    return rows.select(
        *docs.columns, F.col("__m.found").alias("found"), F.col("__m.raw_titles").alias("raw_titles"),
        (F.col("__m.raw_titles") - F.col("__m.n")).alias("duplicates"),
    )


def candidates(
    docs: DataFrame, id_col: str, text: str,
    concepts: Mapping[str, Sequence[str]] = rules.KNOWN_CONCEPTS,
    stopwords: Sequence[str] = rules.STOPWORDS,
    cap: int | None = None,
) -> DataFrame:
    """(id, rank, title, key, raw_titles, duplicates): ``with_candidates`` in rows."""
    rows = with_candidates(docs.select(id_col, text), id_col, text, concepts, stopwords, cap)
    return rows.select(id_col, _exploded("found").alias("c"), "raw_titles", "duplicates").filter("c IS NOT NULL").select(
        id_col, "c.*", "raw_titles", "duplicates")


# --- summaries and registry ------------------------------------------------------------


def _alias_table(concepts: Mapping[str, Sequence[str]]) -> Column:
    pairs: list[Column] = []
    for title, aliases in concepts.items():
        pairs += [F.lit(title), F.array(*[F.lit(a) for a in aliases])]
    return F.create_map(*pairs)


def aliases_of(title: Column, concepts: Mapping[str, Sequence[str]]) -> Column:
    return F.coalesce(_alias_table(concepts)[title], F.array(title))


def alias_items(aliases: Column) -> Column:
    """Aliases prepared for many tests: (alias, low, word, simple).

    A one-word alias is ``simple``: whole-term containment is then the same
    as containment of `` word `` in the blank-separated words of a sentence.
    """
    return F.transform(
        aliases,
        lambda a: F.struct(
            a.alias("alias"), F.lower(a).alias("low"), F.concat(F.lit(" "), F.lower(a), F.lit(" ")).alias("word"),
            a.rlike(rf"^{_W}+$").alias("simple"),
        ),
    )


def sentence_item(sentence: Column) -> Column:
    """A sentence prepared for alias tests: (s, low, words)."""
    return let(
        F.lower(sentence),
        lambda low: F.struct(
            sentence.alias("s"), low.alias("low"),
            F.concat(F.lit(" "), F.regexp_replace(low, f"{tx.NON_WORD}+", " "), F.lit(" ")).alias("words"),
        ),
    )


def _mentions(sentence: Column, alias: Column) -> Column:
    return F.when(alias["simple"], F.contains(sentence["words"], alias["word"])).otherwise(
        F.contains(sentence["low"], alias["low"]) & tx.contains_term(sentence["s"], alias["alias"])
    )


def difficulty(summary: Column) -> Column:
    return F.when(search.any_term(summary, rules.ADVANCED_TERMS), "advanced").otherwise("beginner")


def alias_key(alias: Column) -> Column:
    """The first two words of a lower-case alias, or its only one."""
    words = F.regexp_extract_all(alias, F.lit(f"({_W}+)"), 1)
    return F.array_join(F.slice(words, 1, 2), " ")


def sentence_words(sentences: Column) -> Column:
    """Each sentence as its lower-case words, with blanks between."""
    return F.transform(sentences, lambda s: F.regexp_replace(F.lower(s), f"{tx.NON_WORD}+", " "))


def _met(sentences: Sequence[str], keys: Sequence[str]) -> Iterator[list[int]]:
    """For each sentence the places of the keys it holds, ascending; linear in its words."""
    index: dict[str, list[int]] = {}
    for place, key in enumerate(keys):
        if key:
            index.setdefault(key, []).append(place)
    heads = {key.split(" ")[0] for key in index if " " in key}
    for sentence in sentences:
        words = sentence.split(" ")
        held = index.keys() & words
        if heads:
            held |= index.keys() & [f"{a} {b}" for a, b in zip(words, words[1:]) if a in heads]
        yield sorted(place for key in held for place in index[key])


def _to_certain(places: Sequence[int], certain: Sequence[bool]) -> list[int]:
    """The places up to the first certain one; the others have to be tested."""
    out = []
    for place in places:
        out.append(place)
        if certain[place]:
            break
    return out


def _aliases_met(words, keys, certain) -> list[list[int]]:
    """Per sentence: places of aliases that it may hold, up to the first certain one."""
    return [_to_certain(places, certain) for places in _met(words, keys)]


def _first_met(words, keys, certain, owner) -> list[list[int]]:
    """Per owner: (sentence * number of aliases + alias) of possible hits, up to the first certain one."""
    out: list[list[int]] = [[] for _ in range(max(owner, default=-1) + 1)]
    over = [False] * len(out)
    for pos, places in enumerate(_met(words, keys)):
        for place in places:
            if not over[owner[place]]:
                out[owner[place]].append(pos * len(keys) + place)
        for place in places:
            over[owner[place]] |= certain[place]
    return out


def _with_hits(rows: DataFrame, name: str, find, args: dict[str, Column]) -> DataFrame:
    """Add what ``find`` says of each row's ``args``, lists of whole numbers."""
    made, names = rows.withColumns(args), list(args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(*[batch.column(a).to_pylist() for a in names])
            hits = [None if None in x else find(*x) for x in lists]
            yield batch.drop_columns(names).append_column(name, pa.array(hits, pa.list_(pa.list_(pa.int64()))))

    return made.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.ArrayType(T.ArrayType(T.LongType())))]))


def with_summaries(
    rows: DataFrame, id_col: str, text: str, concepts: Mapping[str, Sequence[str]] = rules.KNOWN_CONCEPTS,
) -> DataFrame:
    """(id, rank, title, summary) for documents with ``found``; further columns stay.

    The summary is the first sentence that holds an alias of the title. Narrow.
    """
    items = F.flatten(F.transform("found", lambda f, i: F.transform(
        alias_items(aliases_of(f["title"], concepts)), lambda a: F.struct(i.alias("owner"), a.alias("a")))))
    rows = rows.withColumns({"__s": sentence_array(tx.nfkc(F.col(text)), 3, 15), "__i": items})
    rows = _with_hits(rows.drop(text), "__p", _first_met, {
        "__w": sentence_words(F.col("__s")), "__k": F.transform("__i", lambda x: alias_key(x["a"]["low"])),
        "__c": F.transform("__i", lambda x: x["a"]["simple"]), "__o": F.transform("__i", lambda x: x["owner"])})

    def held(place: Column) -> Column:
        alias = F.get("__i", (place % F.size("__i")).cast("int"))["a"]
        sentence = F.get("__s", F.floor(place / F.size("__i")).cast("int"))
        return alias["simple"] | _mentions(sentence_item(sentence), alias)

    first = F.transform(F.arrays_zip(F.col("found").alias("f"), F.col("__p").alias("p")), lambda x: let(
        F.get(F.filter(x["p"], held), F.lit(0)),
        lambda place: F.struct(
            x["f"]["rank"].alias("rank"), x["f"]["title"].alias("title"),
            F.coalesce(
                F.get("__s", F.floor(place / F.size("__i")).cast("int")),
                F.concat(x["f"]["title"], F.lit(" is a concept identified in the imported document.")),
            ).alias("summary"))))
    keep = [c for c in rows.columns if c not in (text, "found", "raw_titles", "duplicates", "__s", "__i", "__p")]
    return rows.select(*keep, _exploded(first).alias("__x")).filter("__x IS NOT NULL").select(*keep, "__x.*")


def described(
    docs: DataFrame, found: DataFrame | None, id_col: str, text: str,
    concepts: Mapping[str, Sequence[str]] = rules.KNOWN_CONCEPTS,
    category_rules: Sequence[rules.CategoryRule] = rules.CATEGORY_RULES,
) -> DataFrame:
    """(id, rank, title, slug, summary, difficulty, category) of each candidate.

    ``found`` are candidates as rows; without them, each document's own ones
    are described in its row, and nothing is shuffled.
    """
    if found is None:
        rows = with_candidates(docs.select(id_col, text), id_col, text, concepts)
    else:
        lists = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("found"))
        rows = docs.select(id_col, text).join(lists, id_col)
    rows = rows.withColumn("__categories", search.detect_categories(F.col(text), category_rules))
    rows = with_summaries(rows, id_col, text, concepts)
    category = search.primary_category(F.concat_ws(" ", "title", "summary"), category_rules)
    return rows.withColumn("category", category).select(
        id_col, "rank", "title",
        tx.slugify(F.col("title"), "concept").alias("slug"),
        "summary", difficulty(F.col("summary")).alias("difficulty"),
        F.when(F.array_contains("__categories", F.col("category")), F.col("category"))
        .otherwise(rules.DEFAULT_CATEGORY).alias("category"),
    )


def registry(described_rows: DataFrame, id_col: str, existing: DataFrame | None = None) -> DataFrame:
    """(slug, title, …, first_doc, rank, mentions, status): first arrival per slug.

    Equal lower-case titles share a slug, so the slug decides. ``existing``
    (slug) marks concepts stored earlier as reused. Descriptions that the rows
    do not have are left out.
    """
    carried = [c for c in ("title", "summary", "difficulty", "category") if c in described_rows.columns]
    firsts = first_arrivals(
        described_rows, "slug", [id_col, "rank"], [id_col, "rank", *carried]
    ).withColumnRenamed("arrivals", "mentions")
    if existing is None:
        return firsts.withColumn("status", F.lit("created"))
    known = existing.select("slug").distinct().withColumn("__known", F.lit(True))
    return firsts.join(known, "slug", "left").withColumn(
        "status", F.when(F.col("__known"), "reused").otherwise("created")
    ).drop("__known")


def document_concepts(described_rows: DataFrame, concepts_table: DataFrame, id_col: str) -> DataFrame:
    """Concepts of each document with the registry's title, summary and order."""
    stored = concepts_table.select(
        "slug", F.col("title").alias("concept"),
        *[F.col(c).alias("concept_summary") for c in concepts_table.columns if c == "summary"],
        F.struct(F.col(id_col).alias("d"), F.col("rank").alias("r")).alias("concept_order"),
    )
    return described_rows.select(id_col, "slug").distinct().join(stored, "slug")


# --- claims -----------------------------------------------------------------------------


def claim_type(sentence: Column) -> Column:
    lowered = tx.casefold(sentence)
    chain = None
    for kind, markers in rules.CLAIM_MARKERS:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(lowered, F.lit(marker))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("general")


def claims(
    docs: DataFrame, doc_concepts: DataFrame, id_col: str, text: str,
    concepts: Mapping[str, Sequence[str]] = rules.KNOWN_CONCEPTS,
    existing: DataFrame | None = None,
) -> DataFrame:
    """(claim_key, id, pos, statement, concept, claim_type, confidence, arrivals).

    A sentence belongs to the document's concept with the longest alias it
    holds (earlier concept on a tie); a statement is stored once, globally.
    Texts meet the list of their concepts, one row a document.
    """
    items = doc_concepts.select(
        id_col, "concept_order", "slug", F.explode(alias_items(aliases_of(F.col("concept"), concepts))).alias("alias")
    )
    item = F.struct((-F.length("alias.alias")).alias("n"), "concept_order", "slug", "alias")
    lists = items.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("__i"))
    rows = docs.select(id_col, F.col(text).alias("__t")).join(lists, id_col)
    rows = rows.withColumn("__s", sentence_array(tx.nfkc(F.col("__t")))).drop("__t")
    rows = _with_hits(rows, "__p", _aliases_met, {
        "__w": sentence_words(F.col("__s")), "__k": F.transform("__i", lambda x: alias_key(x["alias"]["low"])),
        "__c": F.transform("__i", lambda x: x["alias"]["simple"])})

    def best(x: Column, pos: Column) -> Column:
        def held(place: Column) -> Column:
            alias = F.get("__i", place.cast("int"))["alias"]
            return alias["simple"] | _mentions(sentence_item(x["s"]), alias)

        place = F.get(F.filter(x["p"], held), F.lit(0))
        return F.struct(pos.alias("pos"), x["s"].alias("statement"), F.get("__i", place.cast("int"))["slug"].alias("concept"))

    met = F.arrays_zip(F.col("__s").alias("s"), F.col("__p").alias("p"))
    picked = rows.select(id_col, _exploded(F.transform(met, best)).alias("x")).select(id_col, "x.*").filter("concept IS NOT NULL")
    picked = picked.withColumn("claim_key", tx.key_of(F.col("statement")))
    if existing is not None:
        picked = picked.join(existing.select("claim_key").distinct(), "claim_key", "left_anti")
    firsts = first_arrivals(
        picked, "claim_key", [id_col, "pos"], [id_col, "pos", "statement", "concept"]
    )
    return firsts.select(
        "*", claim_type(F.col("statement")).alias("claim_type"), F.lit(0.7).alias("confidence")
    )


# --- relations and tags ----------------------------------------------------------------------


def relations(
    doc_concepts: DataFrame, id_col: str,
    relation_rules: Sequence[tuple[str, str, str]] = rules.RELATION_RULES,
) -> DataFrame:
    """(source, relation, target, confidence, first_doc, documents): unique rule edges."""
    wanted = sorted({n.casefold() for s, _, t in relation_rules for n in (s, t)})
    key = tx.key_of(F.col("concept"))
    # only rule concepts are grouped, so a document's set is at most the rule table
    present = doc_concepts.filter(key.isin(wanted)).groupBy(id_col).agg(F.collect_set(key).alias("__k"))
    edges = F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains("__k", s.casefold()) & F.array_contains("__k", t.casefold()),
                    F.struct(F.lit(s).alias("source"), F.lit(r).alias("relation"), F.lit(t).alias("target")),
                )
                for s, r, t in relation_rules
                if s.casefold() != t.casefold()
            ]
        )
    )
    rows = present.select(id_col, F.explode(edges).alias("e")).select(id_col, "e.*")
    firsts = first_arrivals(rows, ["source", "relation", "target"], [id_col], [id_col])
    return firsts.select(
        "source", "relation", "target", F.lit(0.8).alias("confidence"),
        F.col(id_col).alias("first_doc"), F.col("arrivals").alias("documents"),
    )


def tags(
    docs: DataFrame, doc_concepts: DataFrame, id_col: str, text: str,
    tag_rules: Sequence[rules.TagRule] = rules.TAG_RULES,
    level_tags: Sequence[str] = ("beginner", "advanced"),
) -> DataFrame:
    """(slug, tag, documents): tags of each concept, inferred per document.

    A rule is active when the text holds a keyword. Level tags reach every
    concept of the document, with the first level as the default; other tags
    reach the concepts that match by title or summary, else all of them.
    """
    active = F.array_compact(
        F.array(*[F.when(search.any_term(F.col(text), r.keywords), F.lit(r.name)) for r in tag_rules])
    )
    levels = F.array(*[F.lit(x) for x in level_tags])
    with_level = F.when(F.arrays_overlap(active, levels), active).otherwise(
        F.concat(F.array(F.lit(level_tags[0])), active)
    )
    per_doc = docs.select(id_col, with_level.alias("__active"))
    about = F.concat_ws(" ", "concept", "concept_summary")
    matched = F.array_compact(
        F.array(
            *[
                F.when(F.lit(True) if r.everywhere else search.any_term(about, r.keywords), F.lit(r.name))
                for r in tag_rules
            ]
        )
    )
    # matches depend on the stored concept alone, so they are computed once per concept row
    item = F.struct("slug", matched.alias("m"))
    lists = doc_concepts.groupBy(id_col).agg(F.collect_list(item).alias("__c"))
    rows = per_doc.join(lists, id_col).withColumn("tag", F.explode("__active"))
    targets = F.filter("__c", lambda c: F.array_contains(c["m"], F.col("tag")))
    chosen = F.when(F.size(targets) > 0, targets).otherwise(F.col("__c"))
    pairs = rows.select(id_col, "tag", F.explode(chosen).alias("c")).select(id_col, "tag", "c.slug")
    return pairs.groupBy("slug", "tag").agg(F.count_distinct(id_col).alias("documents"))


# --- sources and report -------------------------------------------------------------------------

IDENTITY = ("title", "source_type", "author", "publisher", "publication_year", "url")


def clean_sources(df: DataFrame) -> DataFrame:
    """Tidy source metadata: defaults, lower-case type, integer year; values stay whole."""

    def tidy(name: str, default: str | None = None) -> Column:
        value = F.nullif(tx.normalize_whitespace(F.col(name)), F.lit(""))
        return value if default is None else F.coalesce(value, F.lit(default))

    return df.withColumns(
        {
            "title": tidy("title", "Untitled Document"),
            "source_type": tx.casefold(tidy("source_type", "document")),
            "author": tidy("author"),
            "publisher": tidy("publisher"),
            "url": tidy("url"),
            "publication_year": F.expr("try_cast(publication_year AS INT)"),
        }
    )


def resolve_sources(incoming: DataFrame, stored: DataFrame, id_col: str, stored_id: str) -> DataFrame:
    """(id, matched_id, matched_by): stored source of each incoming one.

    A case-insensitive url match wins; otherwise all six identity fields must
    have equal keys. Stored keys are made unique first (lowest id), so both
    joins are many-to-one.
    """
    def identity(df: DataFrame) -> DataFrame:
        keys = [
            tx.normalize_key(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in IDENTITY
        ]
        return df.withColumn("__url", F.lower("url")).withColumn(
            "__identity", F.sha2(F.to_json(F.array(*keys)), 256)
        )

    new, old = identity(incoming), identity(stored)
    by_url = old.filter("__url IS NOT NULL").groupBy("__url").agg(F.min(stored_id).alias("__u"))
    by_all = old.groupBy("__identity").agg(F.min(stored_id).alias("__i"))
    rows = new.join(by_url, "__url", "left").join(by_all, "__identity", "left")
    return rows.select(
        id_col,
        F.coalesce("__u", "__i").alias("matched_id"),
        F.when(F.col("__u").isNotNull(), "url").when(F.col("__i").isNotNull(), "identity").alias("matched_by"),
    )


def build_report(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, created, reused): counts of each built table by its status column."""
    out = None
    for entity, df in parts.items():
        row = df.agg(
            F.count_if(F.col("status") == "created").alias("created"),
            F.count_if(F.col("status") == "reused").alias("reused"),
        ).select(F.lit(entity).alias("entity"), "created", "reused")
        out = row if out is None else out.unionByName(row)
    return out
