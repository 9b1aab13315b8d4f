import json
import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from readloom.llm.bpe import WHITE, Codec, compile_automaton, decode_ids, tokenize
from readloom.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_encode_and_decode_as_the_library_does(library):
    codec, rng = Codec(compile_automaton(PATH), most_words=500), random.Random(1)
    pool = list("abcdefg hijk tTHE ' 's 're 12 \n.,!? aaaa nnnn == -- __ ²½ⅷ٣éèüßñ中文字😀́​ \x1c\x1f" + "".join(chr(c) for c in range(0x2000, 0x2010)) + WHITE.replace("-", "")) + ["<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["a" * n for n in range(40)] + ["", "<|endoftext|>x<|endoftext|> ", "na" * 50, " " * 30 + "x", "=" * 77]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    broken = [k for t in ("é中", "😀") for k in library.encode(t, add_special_tokens=False).ids][::2]
    assert codec.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_query_digests(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "ab cd", 1), (2, "word " * 60_000, 2), (2, "x", 2), (2, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tokenize(df, PATH, outputs=("ids", "n_tokens", "decoded"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == [(0, 2), (1, 0), (1, 0), (2, 1), (2, 1), (2, 60_001)]
    back = {r.decoded for r in decode_ids(got, PATH).collect()}
    assert back == {"", "ab cd", "word " * 60_000, "x"}
    assert tokenize(df.limit(0), PATH).collect() == []
    clash = df.withColumns({"_id": df["n_tokens"], "_text": df["n_tokens"], "ids": df["n_tokens"]})
    assert sorted(map(str, tokenize(clash, PATH).collect())) == sorted(map(str, tokenize(df, PATH).collect()))


def test_added_tokens_that_take_in_neighbours_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        compile_automaton(str(tmp_path / "t.json"))
