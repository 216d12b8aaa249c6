import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from geoloom.llm import lm_scoring


def test_every_word_counts_by_itself(spark, monkeypatch):
    """6000 distinct words over many blocks and parts of texts, against plain counts."""
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 3000)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{int(6000 * r.random() ** 2)}" for _ in range(r.randrange(700)))) for i in range(60)]
    rows += [(900, " ".join(f"w{i}" for i in range(6000))), (901, None), (None, "w1 w2 W3"), (902, " ".join(f"w{r.randrange(6000)}" for _ in range(250_000)))]  # the last is cut in parts
    got = {x.doc_id: x for x in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")).collect()}

    def model(texts):
        pair, before, after = Counter(), Counter(), Counter()
        for t in texts:
            w = ["", *(t or "").lower().split()]
            pair.update(zip(w, w[1:], strict=False))
            before.update(w[:-1])
            after.update(w[1:])
        a, b, c = lm_scoring.SHARES
        return lambda p: -np.log(a * pair[p] / max(1, before[p[0]]) + b * after[p[1]] / after.total() + c / 6000)

    near, far = model([t for i, t in rows if i is not None and i < 60 and i % 3 == 0]), model([t for _, t in rows])
    assert len(got) == len(rows)
    for i, t in rows:
        w = ["", *(t or "").lower().split()]
        pairs = list(zip(w, w[1:], strict=False))
        want = (np.mean([near(p) for p in pairs]), np.mean([far(p) for p in pairs])) if pairs else (0, 0)
        x = got[i]
        assert x.n_tokens == len(pairs) and (x.target_loss, x.background_loss) == pytest.approx(want, abs=1e-9) and x.score == pytest.approx(want[0] - want[1], abs=1e-9)


def test_a_block_needs_little_memory():
    """300 000 words: what a worker holds beside the words at once stays below 80 bytes a word."""
    r = np.random.default_rng(5)
    words = " ".join(f"w{i}" for i in (60_000 * r.random(300_000) ** 3).astype(int)).encode()
    tracemalloc.start()
    lm_scoring._pairs([100_000, 0, 200_000], [0, 5, 7], words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * 300_000


def test_blocks_lie_apart(spark, monkeypatch):
    """Each block is a file of its own: no reader or writer holds the words of several."""
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 100)
    at = []
    monkeypatch.setattr(lm_scoring, "scratch_path", lambda s, name, f=lm_scoring.scratch_path: at.append((name, f(s, name))) or at[-1][1])
    docs = spark.createDataFrame([(i, f"a b{i} c d e " * 10) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert lm_scoring.score_documents(docs, docs.select("doc_id").limit(3)).count() == 40
    files = [p for p in Path(dict(at)["lm-blocks"].removeprefix("file:")).rglob("*.parquet")]
    assert len(files) == 20 and {pq.ParquetFile(p).metadata.num_rows for p in files} == {1}
