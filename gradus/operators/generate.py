"""Batched text generation with a user-supplied callable.

Rows go through the Python worker in Arrow batches; columns beside the prompt pass unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Generate = Callable[[Sequence[str]], Sequence[str]]

BATCH_SIZE = 128
#: Characters of a batch when all its prompts are padded to the longest.
BATCH_CHARS = 1 << 20
#: Characters of prompts that are put in order of length together.
WINDOW_CHARS = 1 << 24


def length_batches(
    lengths: Sequence[int], batch_size: int = BATCH_SIZE, batch_chars: int = BATCH_CHARS
) -> list[list[int]]:
    """Places of prompts in batches of like lengths, longest first.

    A batch has at most ``batch_size`` prompts and, padded to its longest one, at most
    ``batch_chars`` characters; a longer prompt is a batch of its own.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    batches: list[list[int]] = []
    for i in order:
        last = batches[-1] if batches else None
        if last and len(last) < batch_size and (len(last) + 1) * lengths[last[0]] <= batch_chars:
            last.append(i)
        else:
            batches.append([i])
    return batches


def padding_share(lengths: Sequence[int], batches: Sequence[Sequence[int]]) -> float:
    """Share of padding in batches padded to their longest prompt."""
    whole = sum(len(b) * max(lengths[i] for i in b) for b in batches)
    return 1 - sum(lengths[i] for b in batches for i in b) / whole if whole else 0.0


def _fill(generate: Generate, prompts: list, rows: list[int], texts: list, errors: list) -> None:
    """Generate some prompts at once; those that fail are tried again in halves."""
    try:
        made = list(generate([prompts[i] for i in rows]))
        if len(made) != len(rows):
            raise ValueError(f"{len(rows)} prompts but {len(made)} texts")
        for i, text in zip(rows, made):
            texts[i] = text
    except Exception as failure:  # any failure of the user's model
        if len(rows) > 1:
            for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
                _fill(generate, prompts, half, texts, errors)
        else:
            errors[rows[0]] = f"{type(failure).__name__}: {failure}"


def _windows(prompts: pa.Array, window_chars: int) -> Iterator[tuple[int, int]]:
    """Stretches of prompts of a bounded number of characters, one prompt at least."""
    start = size = 0
    for i, prompt in enumerate(prompts):
        own = len(prompt.as_buffer()) if prompt.is_valid else 0
        if i > start and size + own > window_chars:
            yield start, i
            start, size = i, 0
        size += own
    if len(prompts):
        yield start, len(prompts)


def generate_batch(
    df: DataFrame,
    make_generate: Callable[[], Generate],
    prompt: str = "prompt",
    batch_size: int = BATCH_SIZE,
    batch_chars: int = BATCH_CHARS,
    window_chars: int = WINDOW_CHARS,
    profile=None,
) -> DataFrame:
    """Add ``generated_text`` and ``error``; every row is kept, in order.

    ``make_generate`` is called once per task and returns the function that turns a list of
    prompts into as many texts.  Prompts are batched by length, see :func:`length_batches`, among
    those of ``window_chars`` characters that arrive together, so a long prompt neither pads
    short ones nor gathers with others.  A batch that raises is tried again in halves, so
    only the prompts that fail by themselves get an error; null prompts are passed over.
    ``profile`` is a resource profile for the tasks that generate, as one with GPUs.

    Write the result before using it twice: generation is costly and need not give the
    same text again.
    """
    columns = [c for c in df.columns if c not in ("generated_text", "error")]
    rows = df.select(*[F.col(f"`{c}`") for c in columns])
    text = T.StringType()
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("generated_text", text), T.StructField("error", text)]
    )
    at = columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make_generate()
        for batch in batches:
            for a, b in _windows(batch.column(at), window_chars):
                part = batch.slice(a, b - a)
                prompts = part.column(at).to_pylist()
                texts, errors = [None] * len(prompts), [None] * len(prompts)
                wanted = [i for i, p in enumerate(prompts) if p is not None]
                for chosen in length_batches([len(prompts[i]) for i in wanted], batch_size, batch_chars):
                    _fill(generate, prompts, [wanted[i] for i in chosen], texts, errors)
                added = [pa.array(v, pa.string()) for v in (texts, errors)]
                names = [*columns, "generated_text", "error"]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    return rows.mapInArrow(run, schema, profile=profile)
