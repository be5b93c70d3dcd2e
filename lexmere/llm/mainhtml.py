"""Main text of pages: a linear-chain CRF over leaf blocks, decoded by Viterbi.

Features of a block are the tags above it, what class and id words above it say (all of them,
the nearest, and those of elements around the whole page), the share of the page's text that
stands in its container, its own tag, and the shape of its text; the chain's transitions make
article blocks stand together.
The model is trained on TRAINING_PAGES labelled pages (see labelled.py), a bounded sample
that does not grow with the input; pages are then decoded where they lie, without a shuffle.

Defined cases: null or empty html gives an empty text; markup without text likewise; a page
without an article may give an empty text; repeated rows are extracted row by row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexmere.llm.blocks import Block, leaf_blocks
from lexmere.llm.crf import Chain, train
from lexmere.llm.labelled import MARK, labelled_pages

TRAINING_PAGES = 800
SEED = 20


def features(block: Block, place: int, count: int) -> list[str]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    linked = block.link_chars / n if n else 0.0
    out = ["bias", f"tag:{block.tag}", f"words:{min(words, 128).bit_length()}", f"linked:{min(int(linked * 4), 4)}"]
    out.extend(block.above)
    out.extend([f"near:{mark}" for mark in block.near] or ["near:none"])
    out.extend([f"all:{mark}" for mark in block.wide])
    out.append(f"share:{int(block.share * 5)}")
    if text[-1] in ".!?\"'…:;,":
        out.append("stops")
    if ". " in text or "? " in text or "! " in text:
        out.append("sentences")
    if ", " in text:
        out.append("comma")
    if "©" in text or " · " in text:
        out.append("marks")
    if text[0].isupper():
        out.append("capital")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return out


def page_features(blocks: list[Block]) -> list[list[str]]:
    return [features(b, i, len(blocks)) for i, b in enumerate(blocks)]


def labelled_features(pages: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of marked pages; the mark is taken out first."""
    out = []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "") or " "
        out.append((page_features(blocks), labels))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    return train(labelled_features(labelled_pages(pages, seed)))


def main_text(page: str | None, model: Chain) -> str:
    blocks = leaf_blocks(page or "")
    labels = model.viterbi(page_features(blocks))
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, model: Chain | None = None, *, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """(keep..., text, n_chars) of every row."""
    model = model or trained()
    picked = pages.select(*keep, pages[html].alias("_html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    return picked.mapInArrow(run, f"{kept}, text string, n_chars long")
