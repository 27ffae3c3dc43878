import numpy as np
import pytest

from gradus.llm.tokens import END, PATTERN, TOKENIZER, count_tokens, encoder, write_token_files
from gradus.storage import run_path
from tests.llm.helpers import ODD_TEXTS, docs


def write(folder, name, ids):
    path = folder / name
    path.write_bytes(np.array(ids, dtype="<u2").tobytes())
    return str(path)


def by_hand(ids, end):
    counts, n = [], 0
    for i in ids:
        if i == end:
            counts.append(n)
            n = 0
        else:
            n += 1
    return counts + [n] * (n > 0)


@pytest.mark.parametrize("block", [2, 6, 10, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    cases = [rng.choice([7, 8, 9], 200, p=[0.2, 0.4, 0.4]).tolist() for _ in range(4)]
    cases += [[], [7], [8], [7, 7, 7], [8] * 50, [8] * 50 + [7], [7] + [8] * 50]
    paths = [write(tmp_path, f"{i}.bin", ids) for i, ids in enumerate(cases)]
    frame = spark.createDataFrame([(p,) for p in paths], "file string")
    found = {}
    for r in count_tokens(frame, end=7, block_bytes=block).collect():
        found.setdefault(r.file, {})[r.ordinal] = r.n_tokens
    for path, ids in zip(paths, cases):
        assert [found.get(path, {}).get(i) for i in range(len(by_hand(ids, 7)))] == by_hand(ids, 7)
        assert len(found.get(path, {})) == len(by_hand(ids, 7))


def test_files_give_the_counts_of_the_tokenizer(spark):
    texts = [*ODD_TEXTS, *[f"text {i} " * i for i in range(30)]]
    frame = docs(spark, texts)
    for rotate in (1 << 30, 500):
        written = write_token_files(frame, run_path(spark, "tokens"), rotate=rotate)
        counted = written.join(count_tokens(written.select("file"), block_bytes=128), ["file", "ordinal"])
        encode = encoder(TOKENIZER, PATTERN).encode_ordinary
        assert dict(counted.select("id", "n_tokens").collect()) == {
            i: len(encode(t or "")) for i, t in enumerate(texts)
        }
    assert END not in encode("<|endoftext|>")


def test_odd_tables(spark, tmp_path):
    written = write_token_files(docs(spark, []), run_path(spark, "tokens"))
    assert written.count() == 0 and count_tokens(written.select("file")).count() == 0
    twice = docs(spark, ["a b", None]).selectExpr("*", "1 AS file", "2 AS ordinal", "3 AS id")
    written = write_token_files(twice.unionByName(twice), run_path(spark, "tokens"))
    assert sorted(r.id for r in written.collect()) == [0, 0, 1, 1]
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends inside an identifier"):
        count_tokens(spark.createDataFrame([(str(tmp_path / "odd"),)], "file string")).collect()
