"""Quality rules from the divergence of a document's histograms from those of its language."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import cut, quoted, stored, text_or_empty, unused, without

BLANKS = r"[\x20\x09-\x0D]+"

# Frequent function words of four languages, the bins of the word histogram.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "as", "by", "from", "this", "are",
    "der", "die", "und", "das", "von", "zu", "den", "mit", "nicht", "ein", "eine", "sich", "auf", "für", "ist", "im",
    "de", "la", "le", "et", "les", "des", "du", "un", "une", "que", "qui", "dans", "par", "pour", "sur", "avec",
    "el", "los", "las", "del", "se", "con", "por", "para", "su", "como", "no", "es", "al", "lo", "una", "y",
)

#: Classes of characters in the order in which they are taken out of a text; what is left is the last class, symbols.
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("blank", BLANKS),
    ("upper", r"\p{Lu}+"),
    ("digit", r"\p{Nd}+"),
    ("point", r"""[.,;:!?'"()-]+"""),
    ("letter", r"\p{L}+"),
)
#: Words in a window of the repetition rule.
WIDTH = 5
#: Texts of fewer words have the places of their windows in the low bits of the windows' marks.
MARKED = 1 << 20
#: Languages whose references are broadcast.
MOST_BROADCAST = 2000
ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
    "word_distance", "kept",
)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    *,
    common_words: Sequence[str] = COMMON_WORDS,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    guard_chars: int = 200,
    guard_words: int = 50,
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.45,
    bare_share: float | None = 0.85,
    bare_share_short: float = 0.98,
    short_words: int = 120,
) -> DataFrame:
    """``docs`` with base counts, two Jensen-Shannon distances and the verdict ``kept``.

    References: for each language the histogram of character classes and that of common words, summed over all its
    documents. A document is judged against its language's by the Jensen-Shannon distance (base 2, 0 to 1), by classes
    if it has ``guard_chars`` characters that are no blanks, by words if it has ``guard_words`` words; a shorter one
    has a null distance and passes.

    The word distance of a text without any common word depends on its language's reference alone and is far below 1
    (0.31 where 18 percent of the words are common), so no fixed limit above it rejects such a text. ``bare_share``
    puts a second limit at this share of that distance, and at ``bare_share_short`` of it for texts of fewer than
    ``short_words`` words, whose common words vary by chance; a text beyond either limit is rejected. A reference
    without common words sets no such limit. None leaves ``max_word_distance`` alone.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of the words in five-word windows found twice or more.

    A null text is empty (0 words, so it fails); a null language is the empty name. Repeated rows are judged one by
    one. Columns named like an added one are replaced; others are passed on. Built-in functions only. Counts and
    histograms are computed once and written with their rows to the shared folder; the references, one row of at most
    a few kilobytes a language, are broadcast up to MOST_BROADCAST languages, joined by a shuffle beyond.
    """
    docs = without(docs, *ADDED)
    kept = [quoted(name) for name in docs.columns]
    body, words, lines, windows, pairs, residues, classes, hist, key, solid, ref, ref_key = unused(
        docs, "body_", "words_", "lines_", "windows_", "pairs_", "residues_", "classes_", "hist_", "key_", "solid_",
        "ref_", "ref_key_",
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    measured = docs.select(*kept, text_or_empty(text).alias(body), F.coalesce(quoted(lang).cast("string"), F.lit("")).alias(key))
    measured = measured.withColumns(
        {words: F.filter(F.split(body, BLANKS), lambda word: word != ""), residues: _residues(F.col(body))}
    )
    common = F.filter(words, lambda word: word.isin(list(common_words)))
    measured = measured.withColumns(
        {
            classes: _class_counts(F.col(residues)),
            hist: _bound(common, _word_counts),
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": _removed(F.get(residues, F.lit(4)), "[#*$%&|<>]+").cast("long"),
            lines: F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            windows: F.sort_array(_bound(F.transform(words, lambda word: F.xxhash64(word)), _window_marks)),
        }
    )
    measured = measured.withColumns(
        {
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            pairs: _bound(F.col(windows), _same_marks),
        }
    )
    # equal windows have equal marks, so only windows with an equal mark are compared as text
    every = F.transform(F.col(words), lambda _, i: i)
    doubtful = F.when(F.size(words) < MARKED, F.col(pairs)).otherwise(every)
    repeated = F.when(F.size(doubtful) > 0, _covered(F.col(words), doubtful)).otherwise(0).cast("long")
    measured = measured.withColumns({"n_repeat_words": repeated, solid: F.length(body) - F.get(classes, F.lit(1))})
    measured = stored(measured.select(*kept, key, classes, hist, solid, *counts))

    reference = _references(measured.select(F.col(key).alias("key"), F.col(classes).alias("classes"), F.col(hist).alias("hist"), "n_words"))
    reference = cut(reference.select(F.col("key").alias(ref_key), F.struct("classes", "words", "named").alias(ref)))
    if reference.count() <= MOST_BROADCAST:
        reference = F.broadcast(reference)
    judged = measured.join(reference, F.col(key) == F.col(ref_key), "left").withColumns(
        {
            "class_distance": F.when(F.col(solid) >= guard_chars, _class_distance(F.col(classes), F.col(ref)["classes"])),
            "word_distance": F.when(F.col("n_words") >= guard_words, _word_distance(F.col(hist), F.col("n_words"), F.col(ref))),
            "base_failed": (F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        }
    )
    passes = (
        ~F.col("base_failed")
        & (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance)
        & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    )
    if bare_share is not None:
        share = F.when(F.col("n_words") < short_words, bare_share_short).otherwise(bare_share)
        bare = _bare_distance(F.col(ref)["named"])
        passes &= F.coalesce((bare <= 0) | (F.col("word_distance") <= share * bare), F.lit(True))
    judged = judged.withColumn("kept", passes)
    return judged.select(*kept, *ADDED)


def _references(measured: DataFrame) -> DataFrame:
    """One row a language (key): shares of the classes, shares of the common words, share of all common words.

    Every document gives a row a bin (c0, c1, ... the classes, n all words, w... a word); a language with a third of all
    documents is summed before the shuffle.
    """
    bins = F.concat(
        F.array(F.struct(F.lit("n").alias("bin"), F.col("n_words").alias("n"))),
        F.transform("classes", lambda n, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("bin"), n.cast("long").alias("n"))),
        F.transform("hist", lambda e: F.struct(F.concat(F.lit("w"), e["word"]).alias("bin"), e["n"].cast("long").alias("n"))),
    )
    sums = measured.select("key", F.explode(bins).alias("e")).select("key", "e.bin", "e.n")
    sums = sums.groupBy("key", "bin").agg(F.sum("n").alias("n"))
    folded = sums.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("m"))
    counts = [F.coalesce(F.col("m")[f"c{i}"], F.lit(0)) for i in range(len(CLASSES) + 1)]
    total = F.greatest(sum(counts[1:], counts[0]), F.lit(1))
    all_words = F.greatest(F.col("m")["n"], F.lit(1))
    entries = F.filter(F.map_entries("m"), lambda e: e["key"].startswith("w"))
    shares = F.transform(entries, lambda e: F.struct(F.substring(e["key"], 2, 1 << 30).alias("word"), (e["value"] / all_words).alias("q")))
    named = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"]) / all_words
    return folded.select(
        "key", F.array(*[n / total for n in counts]).alias("classes"), F.map_from_entries(shares).alias("words"), named.alias("named")
    )


def _window_marks(hashes: Column) -> Column:
    """For every window of words its hash, less the low bits, and in those its place: numbers that sort fast."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WIDTH - 1), F.lit(0)))
    return F.transform(
        starts,
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WIDTH)])
        .bitwiseAND(F.lit(-MARKED).cast("long"))
        .bitwiseOR(i.cast("long").bitwiseAND(F.lit(MARKED - 1).cast("long"))),
    )


def _same_marks(marks: Column) -> Column:
    """The places of windows whose hash a neighbour in the sorted marks has."""

    def place(mark: Column, j: Column) -> Column:
        beside = [F.get(marks, j - 1).bitwiseXOR(mark), F.get(marks, j + 1).bitwiseXOR(mark)]
        same = [(x >= 0) & (x < MARKED) for x in beside]
        return F.when(same[0] | same[1], mark.bitwiseAND(F.lit(MARKED - 1).cast("long")).cast("int"))

    return F.filter(F.transform(marks, place), lambda i: i.isNotNull())


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _residues(text: Column) -> Column:
    """[text, text without the first class, without the first two, ...]: each pattern reads what is left only."""
    return F.aggregate(
        F.array(*[F.lit(pattern) for _, pattern in CLASSES]),
        F.array(text),
        lambda left, pattern: F.concat(left, F.array(F.regexp_replace(F.element_at(left, -1), pattern, F.lit("")))),
    )


def _class_counts(residues: Column) -> Column:
    """Characters of each class: what each removal took away, and what was left at the end."""
    return _bound(
        F.transform(residues, F.length),
        lambda lengths: F.transform(lengths, lambda n, i: n - F.coalesce(F.get(lengths, i + 1), F.lit(0))),
    )


def _word_counts(words: Column) -> Column:
    return F.transform(
        F.array_sort(F.array_distinct(words)),
        lambda word: F.struct(word.alias("word"), F.size(F.filter(words, lambda x: x == word)).alias("n")),
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _paired(rows: Column) -> Column:
    """Of (w, i) rows, sorted by w, the rows whose w a neighbour has."""
    marked = F.transform(
        rows, lambda row, j: F.when((F.get(rows, j - 1)["w"] == row["w"]) | (F.get(rows, j + 1)["w"] == row["w"]), row["i"])
    )
    return F.filter(marked, lambda i: i.isNotNull())


def _covered(words: Column, places: Column) -> Column:
    """How many words lie in windows, among those at the given places, whose text is found twice or more."""
    as_text = F.transform(
        F.filter(places, lambda i: i <= F.size(words) - WIDTH),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WIDTH)), " ").alias("w"), i.alias("i")),
    )
    return F.aggregate(
        F.sort_array(_bound(F.sort_array(as_text), _paired)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WIDTH - F.greatest(acc["end"], i)).alias("n"), (i + WIDTH).alias("end")),
        lambda acc: acc["n"],
    )


def _half(p: Column, q: Column) -> Column:
    """p * log2(2p / (p + q)), 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.least(divergence, F.lit(1.0)), F.lit(0.0)))


def _class_distance(counts: Column, reference: Column) -> Column:
    bins = range(len(CLASSES) + 1)
    total = sum((F.get(counts, F.lit(i)) for i in bins[1:]), F.get(counts, F.lit(0)))
    pairs = [(F.get(counts, F.lit(i)) / total, F.get(reference, F.lit(i))) for i in bins]
    terms = [(_half(p, q) + _half(q, p)) / 2 for p, q in pairs]
    return _root(sum(terms[1:], terms[0]))


def _word_distance(hist: Column, n: Column, reference: Column) -> Column:
    """Bins are the common words and all other words together; a bin the document lacks adds half its reference share."""
    words, named = reference["words"], reference["named"]
    pairs = F.transform(hist, lambda e: F.struct((e["n"] / n).alias("p"), F.coalesce(words[e["word"]], F.lit(0.0)).alias("q")))

    def add(acc: Column, pair: Column) -> Column:
        return F.struct(
            (acc["d"] + (_half(pair["p"], pair["q"]) + _half(pair["q"], pair["p"])) / 2).alias("d"),
            (acc["p"] + pair["p"]).alias("p"),
            (acc["q"] + pair["q"]).alias("q"),
        )

    def finish(acc: Column) -> Column:
        other_p, other_q = F.greatest(1 - acc["p"], F.lit(0.0)), F.greatest(1 - named, F.lit(0.0))
        return acc["d"] + (_half(other_p, other_q) + _half(other_q, other_p)) / 2 + F.greatest(named - acc["q"], F.lit(0.0)) / 2

    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    return _root(F.aggregate(pairs, zero, add, finish))


def _bare_distance(named: Column) -> Column:
    """The word distance of a text without common words from a reference of which ``named`` are common words."""
    other = F.greatest(1 - named, F.lit(0.0))
    return _root((_half(F.lit(1.0), other) + _half(other, F.lit(1.0)) + named) / 2)
