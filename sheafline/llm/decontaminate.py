"""Benchmark passages in training texts, found by spaced seeds.

A seed is the hash of the words at the places a fixed mask leaves open, so a changed word at a closed place does not hide
it. Seeds of all benchmark items are joined with seeds of all places of all texts; around each hit the aligned words of text
and item are compared, and a passage counts when some stretch of ``WINDOW`` words (or the whole item, if shorter) has at least
``SHARE`` of them equal. Any four changed words in twenty leave at least one of the two masks a place; items of lengths at which the two
do not suffice have masks of their own, so every passage is found that a comparison of all places would find (tests try all changes).

Everything is expressions and joins. Places are exploded where the text lies, a segment of it at a time, and only hits leave a task; a hit
carries the words around it, never the text, so what a task holds does not grow with texts that hold many passages. The benchmark is
sent to the tasks in blocks of bounded size, one pass over the texts each, so nothing of unknown size is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import stored, texts

# The masks; 1 is a word that must be equal. Stretches of some lengths below ``WINDOW`` have others, as all changes that
# ``SHARE`` allows would not leave the two a place.
MASKS = ("111011", "1101011")
WINDOW, SHARE = 20, 0.8
OTHER_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "11011"), 6: ("1111", "110011"), 7: MASKS + ("11111",),
               10: MASKS + ("1110011",), 11: MASKS + ("11111",), 12: MASKS + ("11111",), 15: MASKS + ("11111",)}
# Letters of scripts that are written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): each is a word.
UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{323af}]"
# Words of benchmark items in one broadcast block.
BLOCK_WORDS = 400_000
# Words of a text whose places are looked at together. Spark holds back what one row gives in a stage of generated code, so a row is
# a segment and not a text.
SEGMENT_WORDS = 1024


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; single letters of scripts without spaces."""
    apart = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), "")


def masks_of(need: int) -> tuple[str, ...]:
    """The masks that find stretches of so many words."""
    return OTHER_MASKS.get(need, MASKS)


def _segments(rows: DataFrame, margin: int) -> DataFrame:
    """``rows`` with ``words`` in segments: ``SEGMENT_WORDS`` of the text from word ``lead`` of the segment on, which are its own, with up
    to ``margin`` more on both sides; the segment begins at word ``base`` of the text."""
    size = F.size("words")
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / SEGMENT_WORDS).cast("int"))

    def cut(k: Column) -> Column:
        first = k * SEGMENT_WORDS
        base = F.greatest(F.lit(0), first - margin)
        held = F.slice("words", base + 1, first - base + SEGMENT_WORDS + margin)
        return F.struct(base.alias("base"), (first - base).alias("lead"), held.alias("words"))

    kept = [c for c in rows.columns if c != "words"]
    return rows.select(*kept, F.explode(F.transform(numbers, cut)).alias("_g")).select(*kept, "_g.base", "_g.lead", "_g.words")


def _placed(rows: DataFrame, masks: list[str], fits: Callable[[str], Column] = lambda mask: F.lit(True)) -> DataFrame:
    """A row for each place of ``words`` (of segments: those of its own) and each mask that ends within them and ``fits``: ``at, seed,
    width``."""
    least, size, at = min(map(len, masks)), F.size("words"), F.col("at")
    first, last = F.lit(0), size - least
    if "lead" in rows.columns:
        first, last = F.col("lead"), F.least(F.col("lead") + (SEGMENT_WORDS - 1), last)
    made = []
    for mask in masks:
        open_ = [F.get("words", at + k) for k, c in enumerate(mask) if c == "1"]
        seed = F.when((at + len(mask) <= size) & fits(mask), F.xxhash64(F.lit(mask), *open_))
        made.append(F.struct(seed.alias("seed"), F.lit(len(mask)).alias("width")))
    there = rows.where(last >= first).withColumn("at", F.explode(F.sequence(first, last)))
    each = there.withColumn("_s", F.explode(F.array(*made)))
    return each.select(*rows.columns, "at", F.col("_s.seed").alias("seed"), F.col("_s.width").alias("width")).where("seed IS NOT NULL")


def _around(hits: DataFrame, window: int) -> DataFrame:
    """``hits`` with those of ``words`` only that a stretch of ``window`` words with the seed can hold; ``base`` and ``at`` likewise."""
    first = F.greatest(F.lit(0), F.col("at") + F.col("width") - window)
    kept = [c for c in hits.columns if c not in ("words", "base", "at", "lead")]
    return hits.select(*kept, F.slice("words", first + 1, F.col("at") + window - first).alias("words"), (F.col("base") + first).alias("base"),
                       (F.col("at") - first).alias("at"))


def _verified(hits: DataFrame, window: int, share: float) -> DataFrame:
    """Hits with ``need`` (words of a stretch), ``matched`` (most equal words in one that holds the seed) and ``start`` (where
    that stretch begins in the text), those with too few left out."""
    hits = hits.withColumn("need", F.least(F.lit(window), F.size("item_words")))
    hits = hits.withColumn("first", F.greatest(F.lit(0), F.col("item_at") + F.col("width") - F.col("need")))
    hits = hits.withColumn("last", F.least(F.col("item_at"), F.size("item_words") - F.col("need")))
    shift = F.col("at") - F.col("item_at")
    same = lambda k: F.when((k + shift >= 0) & (F.get("words", k + shift) == F.get("item_words", k)), 1).otherwise(0)
    hits = hits.withColumn("equal", F.transform(F.sequence("first", F.col("last") + F.col("need") - 1), same))
    total = lambda s: F.aggregate(F.slice("equal", s - F.col("first") + 1, F.col("need")), F.lit(0), lambda a, b: a + b)
    stretches = F.transform(F.sequence("first", "last"), lambda s: F.struct(total(s).alias("n"), (-(s + shift)).alias("back")))
    best = hits.withColumn("best", F.array_max(stretches)).where(F.col("best.n") >= F.ceil(F.col("need") * share))
    return best.withColumn("matched", F.col("best.n")).withColumn("start", F.col("base") - F.col("best.back"))


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, matched, window, start``: one row for each text and item of which it holds a passage.

    ``window`` is the number of words compared, ``matched`` the most of them equal in one stretch, ``start`` the first such
    stretch's word number in the text (from 0); ``text_hash`` is ``xxhash64`` of the text. Words are lower-case runs of letters
    and digits, so case, marks and line ends do not matter. Rows equal in id and text give one row. A null or empty text holds
    nothing; a null id stays null; a null or empty item is never found, and one of up to four words only whole; items that repeat an
    ``item_id`` count under it. Empty tables give no rows; other columns are not looked at. Texts are read whole.
    """
    rows = texts(docs, id_column, text_column).select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.select("item_id", words(F.col("text")).alias("item_words"), F.xxhash64("item_id", "text").alias("item_key"))
    items = stored(items.where(F.size("item_words") > 0), "items")
    n_words = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_words // BLOCK_WORDS))
    lengths = [r[0] for r in items.select(F.least(F.lit(window), F.size("item_words"))).distinct().collect()]  # at most ``window``
    found = [_of_block(rows, items.where(F.pmod("item_key", F.lit(n_blocks)) == b), lengths, window, share) for b in range(n_blocks)]
    every = reduce(DataFrame.unionAll, found)
    return every.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("matched", "back", "window")).alias("best")).select(
        "doc_id", "text_hash", "item_id", "best.matched", "best.window", (-F.col("best.back")).alias("start"))


def _of_block(rows: DataFrame, items: DataFrame, lengths: list[int], window: int, share: float) -> DataFrame:
    masks = sorted({mask for need in lengths for mask in masks_of(need)} or MASKS)
    need = F.least(F.lit(window), F.size("words"))
    fits = lambda mask: need.isin([n for n in lengths if mask in masks_of(n)])
    seeds = _placed(items.select("item_key", F.col("item_words").alias("words")), masks, fits).select(
        "seed", "item_key", F.col("at").alias("item_at"), F.col("width").alias("item_width"))
    placed = _placed(_segments(rows, max(window, *map(len, masks))), masks)
    hits = _around(placed.join(F.broadcast(seeds), "seed").where("width = item_width"), window).join(F.broadcast(items), "item_key")
    return _verified(hits, window, share).select(
        "doc_id", "text_hash", "item_id", F.col("matched").cast("int").alias("matched"), (-F.col("start")).cast("int").alias("back"),
        F.col("need").cast("int").alias("window"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark; all columns as they are."""
    held = stored(find_passages(docs, benchmark, window, share).select("text_hash", "doc_id").distinct(), "contaminated")
    held = held.select(F.col("text_hash").alias("_hash"), F.col("doc_id").alias("_id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(held, (F.xxhash64(text) == F.col("_hash")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
