"""From turns to annotated words to dialogue acts.

A transcript's words are numbered from per-turn counts, packed into character-limited windows
whose state crosses segments as a small transition table, scored window by window, and turned
into dialogue-act rows with the ordered primitives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators.blocks import islands
from turnloom.operators.ordered import Ordering, carry, nearby, renumber

# Window size in characters, and characters a tokenizer leaves behind.
WINDOW_CHARACTERS = 512
PIECE_WORDS = 4096  # words of one value of a text that may be of any length
SENTINEL = "â€”"
LEFTOVER_SEQUENCES = ["â€", "ÄŠ", "Ä\x8a"]
LEFTOVER_CHARACTERS = ["Ä", "Ġ", " ", "Š", "\n"]

Token = dict
Scorer = Callable[[list[str]], Iterable[list[Token]]]


def has_text(column: Column) -> Column:
    return column.isNotNull() & column.rlike(r"\S")


def clean_turns(turns: DataFrame, text: str = "spoken_text",
                content: list[str] | None = None) -> DataFrame:
    """Drop empty rows, rows without text and sentinel rows; dashes become spaces."""
    return (
        turns.na.drop("all", subset=content or [text])
        .filter(has_text(F.col(text)) & (F.col(text) != SENTINEL))
        .withColumn(text, F.regexp_replace(text, "[—–-]", " "))
    )


def scrub(word: Column) -> Column:
    """ASCII characters of a word, without spaces and line breaks.

    Every leftover sequence is made of non-ASCII characters, so one pass drops them all.
    """
    return F.translate(F.regexp_replace(word, r"[^\x00-\x7F]+", ""), " \n", "")


def turn_words(turns: DataFrame, order: Ordering, text: str = "spoken_text") -> DataFrame:
    """One row per word: the turn's other columns, `pos` along the transcript, the word as
    spoken and `scrubbed`. `order` orders the turns.

    Words are counted per turn and turns summed, so numbering never sorts words.
    """
    words = F.filter(F.split(text, " "), has_text)
    counted = turns.withColumn("_words", words).withColumn("_count", F.size("_words").cast("long"))
    numbered = carry(counted, order, running={"_to": F.col("_count")})
    return (
        numbered.select("*", F.posexplode("_words").alias("word_pos", "_word"))
        .withColumns({
            "pos": F.col("_to") - F.col("_count") + F.col("word_pos"),
            text: F.col("_word"),
            "scrubbed": scrub(F.col("_word")),
        })
        .drop("_words", "_count", "_to", "_word")
    )


def merge_speaker_turns(words: DataFrame, order: Ordering, text: str = "spoken_text",
                        piece_words: int = PIECE_WORDS) -> DataFrame:
    """Consecutive words of one speaker as one text; a missing speaker continues the last. A turn has one
    row per `piece_words` words, numbered by `piece`; its text is the pieces joined by a blank."""
    filled = carry(words, order, latest={"_speaker": F.col("speaker")}).withColumn(
        "speaker", F.col("_speaker")).drop("_speaker")
    runs = islands(filled, order, {"turn": F.coalesce(F.col("speaker"), F.lit(""))})
    first = F.col("turn_start").alias("first_pos")
    cut = runs.select("*", first, F.floor((F.col(order.pos) - F.col("turn_start")) / piece_words).alias("piece"))
    return _joined(cut, [*order.keys, "first_pos", "piece"], order.pos, F.col(text), F.first("speaker").alias("speaker"),
                   F.count("*").alias("n_words")).withColumnRenamed("text", text)


def _closings(cum: np.ndarray, lengths: np.ndarray, budget: int, entry: int) -> list[int]:
    """Indices of the words that start a new window, given the length already open."""
    n, found = len(cum), []
    at = int(np.searchsorted(cum, budget - entry, side="right"))
    while at < n:
        found.append(at)
        reach = budget - lengths[at] + cum[at]
        at = max(at + 1, int(np.searchsorted(cum, reach, side="right")))
    return found


def _transition(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """For every open length at a segment's start: the open length at its end and how many
    windows closed. Paths that close at the same word share the rest."""
    pdf = pdf.sort_values("pos")
    lengths = pdf["length"].to_numpy(np.int64)
    cum = np.cumsum(lengths + 1)
    n = len(cum)
    after: dict[int, tuple[int, int]] = {}

    def from_word(first: int) -> tuple[int, int]:
        chain, at = [], first
        while at not in after:
            chain.append(at)
            reach = budget - lengths[at] + cum[at]
            following = max(at + 1, int(np.searchsorted(cum, reach, side="right")))
            if following >= n:
                after[at] = (int(min(lengths[at] + cum[-1] - cum[at], budget)), 1)
                chain.pop()
                break
            at = following
        known = at
        for word in reversed(chain):
            open_length, closed = after[known]
            after[word] = (open_length, closed + 1)
            known = word
        return after[first]

    opens, closes = [], []
    for entry in range(budget + 1):
        first = int(np.searchsorted(cum, budget - entry, side="right"))
        if first >= n:
            opens.append(int(min(entry + cum[-1], budget)))
            closes.append(0)
        else:
            open_length, closed = from_word(first)
            opens.append(open_length)
            closes.append(closed)
    return pd.DataFrame({
        "_source": [pdf["_source"].iloc[0]], "_segment": [pdf["_segment"].iloc[0]],
        "_opens": [opens], "_closes": [closes],
    })


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry state of every segment; rows arrive sorted by source and segment."""
    source, entry, window = None, 0, 0
    for pdf in batches:
        out = []
        for name, segment, opens, closes in zip(
            pdf["_source"], pdf["_segment"], pdf["_opens"], pdf["_closes"]
        ):
            if name != source:
                source, entry, window = name, 0, 0
            out.append((name, segment, entry, window))
            entry, window = int(opens[entry]), window + int(closes[entry])
        yield pd.DataFrame(out, columns=["_source", "_segment", "_entry", "_first"])


def _assign(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    lengths = pdf["length"].to_numpy(np.int64)
    cum = np.cumsum(lengths + 1)
    starts = np.zeros(len(cum), dtype=np.int64)
    starts[_closings(cum, lengths, budget, int(pdf["_entry"].iloc[0]))] = 1
    return pd.DataFrame({
        "_source": pdf["_source"], "pos": pdf["pos"],
        "window": int(pdf["_first"].iloc[0]) + np.cumsum(starts), "word": pdf["word"],
    })


def assign_windows(words: DataFrame, order: Ordering, word: str = "scrubbed",
                   max_length: int = WINDOW_CHARACTERS) -> DataFrame:
    """Greedy packing: every word with its window (source_file, pos, window, word).

    A word that does not fit closes the window and opens the next. The open length is the
    only state. Each segment reports where every possible entry length leads; following
    those short tables gives each segment its true entry, and the segments are then packed
    independently.
    """
    sized = words.select(
        F.col(order.keys[0]).alias("_source"), F.col(order.pos).alias("pos"),
        F.length(word).cast("long").alias("length"),
        (F.lit(0).cast("long") if order.segment_rows is None else order.segment()).alias("_segment"),
        F.col(word).alias("word"),
    )
    if order.segment_rows is None:
        entered = sized.withColumns({"_entry": F.lit(0).cast("long"), "_first": F.lit(0).cast("long")})
    else:
        tables = sized.drop("word").groupBy("_source", "_segment").applyInPandas(
            lambda pdf: _transition(pdf, max_length),
            "_source string, _segment long, _opens array<int>, _closes array<int>",
        )
        entries = tables.repartition("_source").sortWithinPartitions("_source", "_segment").mapInPandas(
            _follow, "_source string, _segment long, _entry long, _first long")
        entered = sized.join(entries, ["_source", "_segment"])
    packed = entered.groupBy("_source", "_segment").applyInPandas(
        lambda pdf: _assign(pdf, max_length), "_source string, pos long, window long, word string")
    return packed.withColumnRenamed("_source", order.keys[0])


def window_texts(windows: DataFrame) -> DataFrame:
    """One row per non-blank window with its words and text; a window is at most the
    character limit or one long word."""
    return (
        windows.groupBy("source_file", "window")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
        .withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " "))
        .filter(has_text(F.col("text")))
    )


def _joined(rows: DataFrame, keys: Sequence[str], pos: str, word: Column, *more: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), word.alias("w")))).alias("_w"), *more).withColumn(
        "text", F.array_join(F.transform("_w", lambda w: w["w"]), " ")).drop("_w")


def one_window(words: DataFrame, word: str = "scrubbed", piece_words: int = PIECE_WORDS) -> DataFrame:
    """Packing switched off: the whole transcript as one text, in numbered pieces (source_file, piece,
    text) of `piece_words` words. The text is the pieces in order, joined by a blank; no value grows
    with the transcript."""
    return _joined(words.withColumn("piece", F.floor(F.col("pos") / piece_words)), ["source_file", "piece"], "pos", F.col(word))


def whole(pieces: DataFrame, keys: Sequence[str], text: str, *more: Column) -> DataFrame:
    """One row per text: its pieces in order, joined by a blank. The text is one value, as large as it is;
    what moves to its task is one row per piece."""
    return _joined(pieces, keys, "piece", F.col(text), *more).withColumnRenamed("text", text)


def clean_token(text: str) -> str:
    """Token text without what tokenizers leave behind."""
    text = text.strip()
    for sequence in LEFTOVER_SEQUENCES:
        text = text.replace(sequence, "")
    return "".join(c for c in text if c not in LEFTOVER_CHARACTERS)


def align(words: list[str], tokens: list[Token]) -> list[list[Token] | None]:
    """Give each word the tokens up to the first one the word ends with.

    Empty tokens are skipped. A word none of the tokens ends takes all that is left; with no
    tokens left a word gets None, as does a word that scrubbing left empty.
    """
    waiting = iter([{**t, "word": w} for t in tokens if (w := clean_token(t["word"]))])
    out: list[list[Token] | None] = []
    for word in words:
        taken = []
        if word:
            for token in waiting:
                taken.append(token)
                if word.endswith(token["word"]):
                    break
        out.append(taken or None)
    return out


def score_words(windows: DataFrame, load_scorer: Callable[[], Scorer], batch_size: int = 16) -> DataFrame:
    """Score windows and align the tokens with the words of the same window.

    `load_scorer` runs once per task and returns a function from texts to token lists; a
    token has `word`, `entity` and `score`. Label and score of a word are those of its first
    token. Alignment never leaves its window, so one bad window cannot shift the next. Only the
    `batch_size` windows that are scored together become Python objects.
    """
    columns = pa.schema([("source_file", pa.string()), ("pos", pa.int64()), ("pred_da", pa.string()),
                         ("raw_score", pa.float64()), ("words_prediction", pa.string())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load_scorer()
        for batch in batches:
            for first in range(0, batch.num_rows, batch_size):
                out = []
                part = batch.slice(first, batch_size).to_pylist()
                for window, tokens in zip(part, scorer([window["text"] for window in part])):
                    words = window["words"]
                    for word, taken in zip(words, align([w["word"] for w in words], tokens)):
                        if taken:
                            out.append((window["source_file"], word["pos"], taken[0]["entity"], taken[0]["score"],
                                        "".join(t["word"] for t in taken)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[i] for row in out], field.type) for i, field in enumerate(columns)], schema=columns)

    return windows.select("source_file", "words", "text").mapInArrow(
        score, "source_file string, pos long, pred_da string, raw_score double, words_prediction string")


def attach_scores(words: DataFrame, scores: DataFrame) -> DataFrame:
    """Labels join words by position; a word without prediction keeps nulls."""
    return words.join(scores, ["source_file", "pos"], "left")


def number_segments(words: DataFrame, order: Ordering, label: str = "pred_da") -> DataFrame:
    """`da_number`: up by one where the label changes and the previous was not inside, and at
    every unlabelled word, which itself gets no number."""
    known = F.col(label).isNotNull()
    marked = carry(words, order, latest={"_latest": F.col(label)})
    marked = nearby(marked, order, {"_previous": lambda w: F.lag("_latest").over(w)}, before=1)
    previous = F.coalesce(F.col("_previous"), F.lit(L.INSIDE_LABEL))
    step = F.when(~known, 1).when(
        (F.col(label) != previous) & (previous != L.INSIDE_LABEL), 1).otherwise(0)
    numbered = carry(marked, order, running={"_number": step.cast("long")})
    return numbered.withColumn("da_number", F.when(known, F.col("_number"))).drop(
        "_latest", "_previous", "_number")


def back_fill(words: DataFrame, order: Ordering, label: str = "pred_da",
              score: str = "raw_score") -> DataFrame:
    """`proc_da` and `score`: an inside word takes those of the next word that is not inside;
    a trailing inside run keeps its own."""
    ends = F.col(label).isNotNull() & (F.col(label) != L.INSIDE_LABEL)
    filled = carry(words, order, upcoming={
        "_label": F.when(ends, F.col(label)), "_score": F.when(ends, F.col(score))})
    known = F.col(label).isNotNull()
    return filled.withColumns({
        "proc_da": F.when(known, F.coalesce(F.col("_label"), F.col(label))),
        "score": F.when(known, F.coalesce(F.col("_score"), F.col(score))),
    }).drop("_label", "_score")


def run_counters(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Words, windows, aligned and unaligned words per transcript."""
    n_windows = windows.groupBy("source_file").agg(F.count("*").alias("n_windows"))
    return (
        words.groupBy("source_file")
        .agg(F.count("*").alias("n_words"), F.count("pred_da").alias("n_aligned"),
             F.count_if(F.col("pred_da").isNull()).alias("n_unaligned"))
        .join(n_windows, "source_file", "left").fillna(0)
    )


def last_row_matches(rows: DataFrame, left: str, right: str, pos: str = "pos") -> DataFrame:
    """Whether two columns agree in the last row of each transcript."""
    return rows.groupBy("source_file").agg(
        F.max_by(F.col(left).eqNullSafe(F.col(right)), pos).alias("matches"))


def collapse(words: DataFrame, order: Ordering, texts: bool = True) -> DataFrame:
    """One row per dialogue act: first speaker, last label, largest flags and codes, text.

    Unnumbered words and segments labelled inside are dropped, then rows are renumbered. With the
    text, an act is one value, as a file's row needs it; `texts=False` leaves the text out and
    `act_texts` gives it in pieces, so that nothing grows with an act.
    """
    present = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    largest = [c for c in ("patient_important", "therapist_important", "patient_code",
                           "therapist_code", "timestamp") if c in words.columns]
    acts = (
        words.filter(F.col("da_number").isNotNull())
        .groupBy("source_file", "da_number")
        .agg(
            F.min_by("speaker", present("speaker")).alias("speaker"),
            F.max_by("proc_da", present("proc_da")).alias("proc_da"),
            *[F.max(c).alias(c) for c in largest],
            *([F.sort_array(F.collect_list(F.when(
                F.col("spoken_text").isNotNull(), F.struct("pos", "spoken_text")))).alias("_w")] if texts else []),
        )
        .filter(F.col("proc_da") != L.INSIDE_LABEL)
        .withColumn("da_group", L.extended_group(F.col("proc_da")))
    )
    if texts:
        acts = acts.withColumn(
            "spoken_text", F.array_join(F.transform("_w", lambda w: w["spoken_text"]), " ")).drop("_w")
    return renumber(acts, order.by("da_number"))


def act_texts(words: DataFrame, acts: DataFrame, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The texts of `acts` in numbered pieces (source_file, da_number, piece, spoken_text), cut where
    word positions pass a multiple of `piece_words`. An act's text is its pieces in order, joined by
    a blank; an act whose words all lack text has none. Pieces are made before they meet the acts, so
    a long act is never one group of words."""
    spoken = words.filter(F.col("da_number").isNotNull() & F.col("spoken_text").isNotNull()).withColumn(
        "piece", F.floor(F.col("pos") / piece_words))
    pieces = _joined(spoken, ["source_file", "da_number", "piece"], "pos", F.col("spoken_text"))
    return pieces.withColumnRenamed("text", "spoken_text").join(
        acts.select("source_file", "da_number"), ["source_file", "da_number"], "left_semi")
