"""Noun lemmas learnt from a corpus: which plural-looking word is a form of which other word, by description length.

English endings propose a base for a word; the corpus decides. A word's neighbours can be coded by how often they stand
beside any word, or by how often they stand beside its base. If the second takes fewer bits, and loses little on
either side, the word is used as its base is, and is taken for a form of it: *cats* stands where *cat* does,
while what follows *news* does not follow *new*. Rare neighbours count by their last letters. Words of irregular form
come from a list. Where the corpus says too little a word stays as it is. Nothing is capped; all of it is counts and
joins of word pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut
from corpusmill.functions.text import NOUN_ENDINGS, Step, by_word, tokens

#: Share of the whole corpus in the code by a base's neighbours: one that its base never has costs this much more.
BACKGROUND = 0.5
#: What the neighbours of one side may cost more, in bits an occurrence.
LOSS = 0.25
#: Neighbours of more than three letters that make up less than a thousandth of all words stand for all that end as they do.
COMMON, SHORT, LAST_LETTERS = 1000, 3, 2
#: A base is a word at least a twentieth as frequent as the form, and has so many letters.
RATIO, LEAST_LETTERS = 20, 3
BEGIN, END = "^", "$"
MARK = "\x01"
# English nouns of irregular plural, form and base in pairs.
IRREGULAR_NOUNS = """
alumni alumnus analyses analysis antennae antenna bacteria bacterium brethren brother cacti cactus calves calf cherubim cherub children child
concerti concerto corpora corpus crises crisis criteria criterion curricula curriculum diagnoses diagnosis dwarves dwarf elves elf emphases emphasis
errata erratum feet foot foci focus formulae formula fungi fungus geese goose genera genus halves half hooves hoof hypotheses hypothesis indices index
knives knife larvae larva leaves leaf lice louse lives life loaves loaf matrices matrix memoranda memorandum men man mice mouse nebulae nebula nuclei
nucleus oases oasis octopi octopus oxen ox parentheses parenthesis phenomena phenomenon quizzes quiz radii radius scarves scarf selves self shelves
shelf sheaves sheaf spectra spectrum stimuli stimulus strata stratum syllabi syllabus symposia symposium synopses synopsis teeth tooth theses thesis
thieves thief vertebrae vertebra vertices vertex wives wife wolves wolf women woman
""".split()
IRREGULAR = dict(zip(IRREGULAR_NOUNS[::2], IRREGULAR_NOUNS[1::2], strict=True))


def neighbours(texts: DataFrame) -> DataFrame:
    """(a, b, n): how often word b follows word a in (text); a text begins and ends with a mark of its own."""
    words = texts.select(F.concat(F.array(F.lit(BEGIN)), tokens(F.coalesce(F.col("text"), F.lit(""))), F.array(F.lit(END))).alias("ws"))
    each = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.struct(F.element_at("ws", i).alias("a"), F.element_at("ws", i + 1).alias("b")))
    return words.select(F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def proposed(words: DataFrame) -> DataFrame:
    """(word, base): for each word the bases that the endings give, where a rule fits.

    A bare *s* is no ending after *s*, *i* or *u* (pass, basis, virus).
    """
    w = F.col("word")
    of = lambda end, new: F.when(w.endswith(end), F.concat(F.expr(f"left(word, length(word) - {len(end)})"), F.lit(new)))
    bases: list[Column] = [F.when(~w.rlike("[siu]s$"), of(end, new)) if end == "s" else of(end, new) for end, new in NOUN_ENDINGS]
    found = words.select("word", F.explode(F.array_distinct(F.filter(F.array(*bases), lambda b: b.isNotNull()))).alias("base"))
    return found.where((F.length("base") >= LEAST_LETTERS) & (F.col("base") != w))


def noun_lemmas(texts: DataFrame) -> DataFrame:
    """(word, lemma, gain): the words of (text) that are forms of another word of it, and the bits that this saves.

    Of several bases the one that saves most is the lemma, the shorter of equals. Runs actions that write the
    counts once.
    """
    pairs = cut(neighbours(texts))
    counts = cut(pairs.where(F.col("b") != END).groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("n")))
    size = counts.select(F.col("word").alias("base"), F.col("n").alias("n_base"))
    asked = proposed(counts.select("word")).join(size, "base").join(counts, "word").where(F.col("n_base") * RATIO >= F.col("n"))
    asked = cut(asked.select("word", "base", "n_base"))
    total = pairs.agg(F.sum("n").alias("total"))
    sides = None
    for own, other in (("b", "a"), ("a", "b")):  # the words before, then those after
        each = pairs.select(F.col(own).alias("w"), F.col(other).alias("x"), "n")
        often = each.groupBy("x").agg(F.sum("n").alias("n_x")).crossJoin(F.broadcast(total))  # one row
        own_kind = (F.col("n_x") * COMMON >= F.col("total")) | (F.length("x") <= SHORT)
        named = F.when(own_kind, F.col("x")).otherwise(F.concat(F.lit("-"), F.right("x", F.lit(LAST_LETTERS))))
        kinds = often.select("x", named.alias("kind"), "n_x", "total")
        share = kinds.groupBy("kind").agg((F.sum("n_x") / F.first("total")).alias("p"))
        beside = cut(each.join(kinds.select("x", "kind"), "x").groupBy("w", "kind").agg(F.sum("n").alias("n")))
        seen = asked.join(beside.withColumnRenamed("w", "word"), "word")
        known = beside.select(F.col("w").alias("base"), "kind", F.col("n").alias("n_both"))
        bits = F.log2((1 - BACKGROUND) * F.coalesce("n_both", F.lit(0)) / (F.col("n_base") * F.col("p")) + BACKGROUND)
        side = seen.join(known, ["base", "kind"], "left").join(share, "kind").groupBy("word", "base").agg(F.sum(F.col("n") * bits).alias("bits"), F.sum("n").alias("n"))
        sides = side if sides is None else sides.unionByName(side)
    saved = sides.groupBy("word", "base").agg(F.sum("bits").alias("gain"), F.min(F.col("bits") / F.col("n")).alias("least")).where((F.col("gain") > 0) & (F.col("least") > -LOSS))
    best = saved.groupBy("word").agg(F.max_by(F.struct("base", "gain"), F.struct("gain", -F.length("base"))).alias("b"))
    return best.select("word", F.col("b.base").alias("lemma"), F.col("b.gain").alias("gain"))


def lemmatizer(learnt: DataFrame, at_once: int = 500_000) -> Step:
    """A cleaning step that replaces irregular forms and what ``noun_lemmas`` found (an action collects it in slices).

    A slice of the forms, dealt by hash, is held by a worker at a time; there are as many steps as slices, and a mark
    keeps what one has changed from the next.
    """
    slices = max(1, -(-learnt.count() // at_once))
    dealt = learnt.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(slices)))
    maps = [{r["word"]: r["lemma"] for r in dealt.where(F.col("slice") == k).collect()} for k in range(slices)]
    maps[0].update(IRREGULAR)
    for m in maps[1:]:
        for form in IRREGULAR:
            m.pop(form, None)
    if slices == 1:
        return by_word(lambda w: maps[0].get(w, w))
    steps = [by_word(lambda w, m=m: MARK + m[w] if w in m else w) for m in maps]

    def run(c: Column) -> Column:
        for step in steps:
            c = step(c)
        return F.regexp_replace(c, MARK, "")

    return run
