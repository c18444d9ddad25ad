"""Keyword-stuffed texts, link lists and product tags among spoken text.

A document is read line by line.  For every line the recurrence gaps of its
content words (distance in words to the same word before and behind) and the
positional autocorrelation over a window of lags are measured, next to the
share of function words and of link, tag and article-number tokens:

* stuffed: content words come back inside the line and the autocorrelation of
  the line over lags 1..LAGS is unnaturally high;
* list: several distinct nouns, no function words and no sentence punctuation,
  with words that recur at short gaps, or many of them in one line;
* link / tag / article lines: hardly anything but such tokens.

A document is a case when these lines hold more than half of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.cues import FRAMES, SOUND, TAG, TIME_LINE, closed, foreign, ideogram, plain

LAGS = 24  # words

# fixed values: frequent function words without accents (English, German, French, Spanish, Norwegian)
FUNCTION_WORDS = frozenset(
    b"""a an the is are was were be been and or but of to in on at by for with from not no you i we he she it they me us my your our
    his her its their this that who what where when if as so do did don't can't won't never isn't there here between near under
    der die das ein eine ist sind war und oder aber nicht mit von zu auf fur ich du er sie wir ihr es wer wo warum hat habe haben hier
    le la les un une des du de et ou est sont etait ne en au je tu il elle nous vous ce c'est qui que avec dans sur pour
    el los las una y o es esta son era lo se del al con por para donde quien que he ha hemos hay
    og er en et ei den det som har jeg vi dere ikke til fra av hvem hvor noe deg""".split()
)
WORD = re.compile(rb"#\w[\w'-]*|\w[\w'./:@=?&-]*")
LINK = re.compile(rb"https?:|^www\.|[a-z0-9-]\.[a-z]{2,12}(?:/|$)")
ARTICLE = re.compile(rb"^[a-z]{2,4}-\d{3,}$|^\d+[.,]\d\d$")
SENTENCE_END = re.compile(rb"[.?!][\"')\]\s>-]*$")
EDGE = b".,:;!?'-/"


def _lines(text: str) -> list[bytes]:
    s = plain(text)
    if b"\r" in s:
        s = s.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if b":" in s:
        s = TIME_LINE.sub(b"", s)
    if b"{" in s:
        s = FRAMES.sub(b" ", s)
    if b"<" in s:
        s = TAG.sub(b" ", s.replace(b"<a href=", b" http://link/ <a href="))
    if b"[" in s or b"(" in s or b"*" in s:
        s = SOUND.sub(closed, s)
    return s.split(b"\n")


def _autocorrelation(words: list[bytes], start: int, end: int) -> float:
    """Highest share of words[start:end] that equal the word ``lag`` places before or behind, over the lag window."""
    n, best = len(words), 0
    for lag in range(1, LAGS + 1):
        same = 0
        for i in range(start, end):
            w = words[i]
            if (i >= lag and words[i - lag] == w) or (i + lag < n and words[i + lag] == w):
                same += 1
        best = max(best, same)
    return best / max(1, end - start)


def spam_share(text: str) -> float:
    """Share of the characters of a text that stand in stuffed, list, link, tag or article lines."""
    rows = []  # (line, first word, end word)
    words: list[bytes] = []
    for line in _lines(text):
        line = line.strip()
        if not line or line.isdigit() or line.startswith(b"webvtt"):
            continue
        got = [w.rstrip(EDGE) for w in WORD.findall(line)]
        if not got:
            continue
        rows.append((line, len(words), len(words) + len(got)))
        words += got
    if not rows:
        return 0.0
    # recurrence gaps: distance to the nearest same word
    last: dict[bytes, int] = {}
    gap = [LAGS * 100] * len(words)
    for i, w in enumerate(words):
        j = last.get(w)
        if j is not None:
            g = i - j
            gap[i] = g
            if g < gap[j]:
                gap[j] = g
        last[w] = i
    bad = total = 0
    for line, a, b in rows:
        size = b - a
        total += len(line)
        own = words[a:b]
        content = [w for w in own if w not in FUNCTION_WORDS]
        nc = len(content)
        function = size - nc
        ended = line[-1] in b".?!" or b". " in line or b"? " in line or SENTENCE_END.search(line) is not None
        special = 0
        if b"#" in line or b"." in line or b"-" in line or b":" in line:
            special = sum(w[:1] == b"#" or LINK.search(w) is not None or ARTICLE.match(w) is not None for w in content)
        if special:
            # link, tag and article lines: besides them only content words, and few
            if function * 5 <= size and (special * 4 >= size or (not ended and function == 0)):
                bad += len(line)
            continue
        if nc < 2:
            continue
        distinct = len(set(content))
        # what stands before a colon is a label: only the words it introduces tell whether they recur
        start = a + len(WORD.findall(line[: line.index(b":")])) if b":" in line else a
        told = [i for i in range(start, b) if words[i] not in FUNCTION_WORDS]
        near = sum(gap[i] <= LAGS for i in told) / max(1, len(told))
        # no function words are known of other scripts: there the repetition alone decides, for ideograms a stricter one
        other = sum(map(foreign, own)) * 2 > size
        if other:
            least = 0.5 if sum(map(ideogram, own)) * 2 > size else 0.25
            if nc >= 4 and not ended and distinct * 5 <= nc * 3.2 and _autocorrelation(words, a, b) >= least:
                bad += len(line)
            continue
        if function * 8 <= size and not ended:
            # nouns without function words: recurring ones, or a long row of different ones
            listed = line.count(b",") + line.count(b";") + line.count(b"|")
            if (near >= 0.5 and (nc >= 4 or listed)) or (distinct >= 6 and not function and listed * 2 < nc):
                bad += len(line)
                continue
            if listed >= 2 and near >= 0.3:
                bad += len(line)
                continue
        if nc >= 4 and not ended and distinct * 5 <= nc * 3.2 and _autocorrelation(words, a, b) >= 0.25:
            bad += len(line)
    return bad / total if total else 0.0


def find_spam(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id`` and ``spam_share`` of documents whose spam share exceeds ``threshold``.

    One pass, no shuffle: each document is judged by its own words, in any
    script.  Null or
    empty texts and null ids are no cases; repeated documents count each; whole
    texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, shares = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                share = spam_share(t.as_py())
                if share > threshold:
                    ids.append(d)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "spam_share"])

    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return corpus.mapInArrow(run, "doc_id bigint, spam_share double").select(F.col("doc_id").alias(doc_id), "spam_share")
