"""The pipeline's stages keep the columns of documents, and its run gives shards."""

import glob
import os
import random
from urllib.parse import urlparse

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_near_copies import kept_by_hand

from quern.llm.common import shared_folder
from quern.llm.queries import OP3, OP4

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the sample tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    for name in list(stages)[:4]:
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.law for r in rows} == {"rows"} and max(r.shard for r in rows) == 15


def _tables(folder):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [[f"item{k}x{j}" for j in range(20)] for k in range(4)]
    texts = [text(rng.randint(50, 70)) for _ in range(500)]
    toxic = set(range(0, 500, 5))
    for k in sorted(toxic):
        for insult in ("vile", "scum"):
            texts[k].insert(rng.randrange(len(texts[k])), insult)
    for k in range(1, 20, 5):
        texts.append([*texts[k][:30], "changed", *texts[k][31:]])
        texts.append(["Changed", *texts[k][1:25], "twice", *texts[k][26:40], "thrice", *texts[k][41:]])
        texts.append(list(texts[k]))
    for k, item in enumerate(items):
        texts.append([*text(30), *item[k : k + 13], *text(20)])
        texts.append([*text(30), *item[:12], *text(20)])
        texts.append([*text(300), *item[:13], *text(200)])
    order = rng.sample(range(len(texts)), len(texts))
    docs = [(d, " ".join(texts[k]), f"s{k % 4}") for d, k in enumerate(order)]
    labels = [(d, int(k in toxic)) for d, k in enumerate(order)]
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs], "source": [r[2] for r in docs]}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [r[0] for r in labels], "toxic": [r[1] for r in labels]}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": list(range(4)), "text": [" ".join(i) for i in items]}), f"{folder}/benchmark.parquet")
    return docs, items


def _contaminated(text, items):
    words, hit = text.lower().split(), set()
    runs = {tuple(i[k : k + 13]) for i in items for k in range(len(i) - 12)}
    for k in range(len(words) - 12):
        if tuple(words[k : k + 13]) in runs:
            hit.update(range(k, k + 13))
    return bool(hit)


def test_survivors_of_the_chain(spark, tmp_path):
    """What the stages of one run keep, each read where it was written, against brute force on the stage before."""
    import corpus_pipeline

    folder = str(tmp_path / "tables")
    docs, items = _tables(folder)
    runs = lambda: set(glob.glob(f"{urlparse(shared_folder(spark)).path}/pipeline-*/[0-3]"))
    before = runs()
    got = corpus_pipeline.run(spark, folder)
    made = sorted(runs() - before, key=os.path.basename)
    assert len(made) == 4
    ids = [sorted(r.doc_id for r in spark.read.parquet(path).collect()) for path in made]
    clean = [r for r in docs if not {"vile", "scum"} & set(r[1].split())]
    assert ids[0] == [r[0] for r in clean]
    apart = kept_by_hand([r[:2] for r in clean])
    assert ids[1] == apart and len(apart) == len(clean) - 8
    left = [r[0] for r in clean if r[0] in set(apart) and not _contaminated(r[1], items)]
    assert ids[2] == left and len(left) == len(apart) - 8
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{made[2]}/*.parquet'")
    taken = con.execute(f"SELECT doc_id, taken // size FROM ({OP4})").fetchall()
    assert ids[3] == sorted(d for d, copies in taken for _ in range(copies))
    con.execute(f"CREATE OR REPLACE TABLE documents AS SELECT * FROM '{made[3]}/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, text_crc32, shard, slot FROM ({OP3})").fetchall()
    assert sorted(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == sorted(want)
