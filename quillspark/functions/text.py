"""Column expressions for tokens, term keys and match scores. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest word kept whole; of a longer one its last letters stay, unless it ends the text.
WORD_CAP = 50

#: Shorter words are dropped.
MIN_WORD = 3

#: Dropped where the text has them in capitals, unless they end the text.
STOP_WORDS = frozenset(
    "A ABOUT ABOVE AGAIN ALL AM AN AND ANY ARE AS AT BE BEEN BEING BELOW BOTH BUT BY CAN DID DO DOES DOING DON EACH FEW FOR FROM HAD HAS HAVE HE HER HERE HERS HIM HIMSELF HIS HOW I IF IN INTO IS IT ITS ITSELF JUST ME MORE MOST MY MYSELF NO NOR NOT OF OFF ON ONCE ONLY OR OTHER OUR OURS OURSELVES OUT OVER OWN S SAME SHE SO SOME SUCH T THAN THAT THE THEIR THEIRS THEM THERE THESE THEY THIS THOSE THROUGH TO TOO UNDER UNTIL VERY WAS WE WERE WHAT WHEN WHERE WHICH WHILE WHO WHOM WHY WILL WITH YOU YOUR YOURS".split()
)

#: Letters of a term that its numeric key holds, and the key of a step of one on the fifth.
KEY_LETTERS = 11
KEY_STEP = 27**7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, not again for each element that a lambda in body meets."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column, block: int = 32) -> Column:
    """The sum up to each element of an array of whole numbers.

    An array grows by being copied, so sums are first made block by block, and
    blocks are then raised by what came before them.
    """

    def blocks(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(n) - 1, F.lit(0)) / block).cast("int")), lambda k: F.slice(n, k * block + 1, F.lit(block)))

    def grow(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    def raised(parts: Column) -> Column:
        return let(F.aggregate(parts, F.array(F.lit(0)), lambda a, p: grow(a, F.element_at(p, -1))), lambda base: F.flatten(F.zip_with(parts, F.slice(base, 1, F.size(parts)), lambda p, up: F.transform(F.slice(p, F.lit(2), F.lit(block)), lambda x: x + up))))

    whole = let(numbers, lambda n: F.transform(blocks(n), lambda p: F.aggregate(p, F.array(F.lit(0)), grow)))
    return let(whole, raised)


def words(text: Column) -> Column:
    """Runs of ASCII letters of a text as structs: raw, start, and whether the run ends the text.

    A run of more than WORD_CAP letters keeps its last ones, from where they
    begin, unless it ends the text.
    """
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    with_gaps = F.regexp_extract_all(text, F.lit("[^A-Za-z]*[A-Za-z]+"), F.lit(0))
    whole = F.struct(F.length(text).alias("size"), runs.alias("raw"), running_sums(F.transform(with_gaps, F.length)).alias("ends"))

    def capped(raw: Column, end: Column, past: Column) -> Column:
        size = F.length(raw)
        last = end == past
        over = (size > WORD_CAP) & ~last
        return F.struct(F.when(over, F.right(raw, F.lit(WORD_CAP))).otherwise(raw).alias("raw"), F.when(over, end - WORD_CAP).otherwise(end - size).alias("start"), last.alias("last"))

    return let(whole, lambda w: F.zip_with(w.getField("raw"), w.getField("ends"), lambda raw, end: capped(raw, end, w.getField("size"))))


def is_stop_word(raw: Column) -> Column:
    return raw.isin(*sorted(STOP_WORDS))


def tokens(text: Column, stop_words: bool = True) -> Column:
    """Index terms of a text as structs (term, pos): capitals, MIN_WORD letters at least, no stop words."""

    def kept(word: Column) -> Column:
        raw = word.getField("raw")
        fits = F.length(raw) >= MIN_WORD
        return fits & (word.getField("last") | ~is_stop_word(raw)) if stop_words else fits

    return F.transform(F.filter(words(text), kept), lambda w: F.struct(F.upper(w.getField("raw")).alias("term"), w.getField("start").alias("pos")))


def clean_query(terms: Column, stop_words: bool = False) -> Column:
    """Query terms in capitals, those of MIN_WORD letters at least, optionally without stop words."""
    upper = F.filter(F.transform(terms, F.upper), lambda t: F.length(t) >= MIN_WORD)
    return F.filter(upper, lambda t: ~is_stop_word(t)) if stop_words else upper


def split_query(text: Column) -> Column:
    """The words of a typed query: capitals, split at spaces and pluses, empty ones dropped."""
    return F.filter(F.split(F.upper(text), "[ +]"), lambda t: t != "")


def ascii_for_index(text: Column) -> Column:
    """Every character beyond ASCII becomes a question mark, so that offsets stay."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "?")


def ascii_for_store(text: Column) -> Column:
    """Without double quotes, backslashes and characters beyond ASCII."""
    return F.regexp_replace(F.translate(text, '"\\', ""), "[^\\x00-\\x7F]", "")


def term_key(term: Column) -> Column:
    """The first letters of a term in capitals as a number to the base 27: numbers sort as terms do."""
    letters = [F.when(F.length(term) > i, (F.ascii(F.substr(term, F.lit(i + 1), F.lit(1))) - 64).cast("long") * 27 ** (KEY_LETTERS - i)).otherwise(0) for i in range(KEY_LETTERS)]
    return sum(letters[1:], letters[0])


def common_prefix(a: Column, b: Column) -> Column:
    """Letters that two terms have in common at their beginning."""
    size = F.least(F.length(a), F.length(b))
    return F.when(size == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i))))


def match_score(query: Column, key: Column) -> Column:
    """How well a key answers a query term: common letters, less for a difference in length, more for a whole prefix."""
    common = common_prefix(query, key)
    apart = F.abs(F.length(query) - F.length(key))
    damp = (F.lit(7.0) / (apart + 7)).cast("float").cast("double")
    return common * damp * F.when(query == key, 15).when(common == F.length(query), 8).otherwise(1)


#: Accepted keys before the cutoff follows their scores; the cutoff till then; and its factor after.
FIRST_KEYS, FIRST_CUTOFF, CUTOFF_FACTOR = 12, 4.0, 1.9


def accepted_keys(scored: Column) -> Column:
    """Of structs (term_ord, term, score), in order of term_ord, those whose score reaches the cutoff of the moment."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.filter(scored, lambda x: F.lit(False)).alias("kept"))

    def step(state: Column, x: Column) -> Column:
        n, total = state.getField("n"), state.getField("total")
        mean = F.floor((total + n) / F.greatest(n, F.lit(1))).cast("double")
        cutoff = F.when(n < FIRST_KEYS, FIRST_CUTOFF).otherwise(mean * CUTOFF_FACTOR)
        more = F.struct((n + 1).alias("n"), (total + x.getField("score")).cast("long").alias("total"), F.concat(state.getField("kept"), F.array(x)).alias("kept"))
        return F.when(x.getField("score") >= cutoff, more).otherwise(state)

    return F.aggregate(F.array_sort(scored), start, step, lambda s: s.getField("kept"))


def posting_score(tf: Column, score: Column) -> Column:
    return ((F.log10(tf.cast("double")) + 1) * score).cast("long")
