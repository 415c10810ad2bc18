"""Which documents the vocabulary queries count: all of them, whatever their split."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, difference

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# doc_id % 21 + 1 is the group: 0 and 1 are in the training split, 4 in the test split, 5 in the evaluation split
TEXTS = [(0, "ab ab"), (1, "ba c"), (4, "xx y" + "z" * 11), (5, "ÄÄ x"), (25, ""), (26, "c|ö")]


@pytest.fixture(scope="module")
def split_folder(spark, small, tmp_path_factory):
    """The test tables with documents of all three splits."""
    folder = tmp_path_factory.mktemp("splits")
    for name in ("benchmark", "conversations", "embeddings", "events", "labels", "pages", "region", "nation", "customer",
                 "supplier", "part", "orders", "lineitem"):
        (folder / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    rows = [(i, t, "de", "src1", len(t)) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(
        str(folder / "written"))
    next((folder / "written").glob("*.parquet")).rename(folder / "documents.parquet")
    return str(folder)


def found(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    assert difference(frame, connect(folder), ORACLES[name]) == ""
    return frame.collect()


def test_char_freq_counts_every_split(spark, split_folder):
    got = {r["ch"]: (r["freq"], r["first_row"], r["first_pos"]) for r in found(spark, split_folder, "char_freq")}
    assert got == {"a": (3, 0, 0), "b": (3, 0, 1), " ": (4, 0, 2), "c": (2, 1_000_000, 3), "x": (3, 4_000_000, 0),
                   "y": (1, 4_000_000, 3), "z": (11, 4_000_000, 4), "ä": (2, 5_000_000, 0), "|": (1, 26_000_000, 1),
                   "ö": (1, 26_000_000, 2)}


def test_char_vocab_numbers_characters_of_every_split(spark, split_folder):
    got = {(r["token"], r["id"], r["freq"]) for r in found(spark, split_folder, "char_vocab")}
    assert got == {("a", 1, 3), ("b", 2, 3), ("|", 3, 4), ("c", 4, 2), ("x", 5, 3), ("z", 7, 11), ("ä", 8, 2), ("[UNK]", 7, None)}


def test_char_vocab_dense_numbers_characters_of_every_split(spark, split_folder):
    got = {(r["token"], r["id"], r["freq"]) for r in found(spark, split_folder, "char_vocab_dense")}
    assert got == {("z", 1, 11), ("[UNK]", 2, None), ("[PAD]", 3, None)}


def test_encode_labels_knows_characters_of_every_split(spark, split_folder):
    got = {r["utt_id"]: r["labels"] for r in found(spark, split_folder, "encode_labels")}
    assert got == {0: "1 2 3 1 2", 1_000_000: "2 1 3 4", 4_000_000: "5 5 3 7" + " 7" * 11, 5_000_000: "8 8 3 5",
                   25_000_000: "", 26_000_000: "4 3 7"}
