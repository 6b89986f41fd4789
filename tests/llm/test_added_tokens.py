"""Added tokens of the JSON vocabulary, found in texts as the tokenizer library finds them."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from tracklore.llm.bpe import Encoder, load_added, load_ranks
from tracklore.llm.packing import pack_documents

PATH = P.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, END * 3, f"{END}\n\n it's{END}it's  {END}", "<|endof", "text|> x", f"caf\u00e9 \u00a0{END}\u00a0 9{END[:-1]}", "", None, "plain  text ", f"<|{END}|>", f"x{END}"]


def test_encoder():
    own, library = Encoder(load_ranks(PATH), load_added(PATH)), Tokenizer.from_file(PATH)
    for texts in (TEXTS, TEXTS[::-1], ["no such token", "here"]):
        ids, off = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    library = Tokenizer.from_file(PATH)
    rows = pack_documents(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), PATH).collect()
    want = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in enumerate(TEXTS)}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in rows} == {(k, len(x), zlib.crc32(x.tobytes())) for k, x in want.items()}
