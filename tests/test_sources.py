"""Large files by byte ranges equal the same files read whole."""

from pyspark.sql import functions as F

from pokerlake.operators import hand_text
from pokerlake.sources.files import read_hand_blocks, read_text_files
from tests.samples import QUIET_HAND, SHOWDOWN_HAND


def hand(i):
    sample = (SHOWDOWN_HAND if i % 3 else QUIET_HAND).replace("TX50060", f"TX{i}x")
    return sample + ("\n\nfree text after a blank line" if i % 7 == 0 else "")


def write(folder):
    folder.mkdir()
    texts = [hand(i) for i in range(900)]
    (folder / "large.txt").write_text("\n\n\n".join(texts), newline="")
    (folder / "windows.txt").write_text("\n\n".join(t.replace("TX", "WX") for t in texts[:300]).replace("\n", "\r\n") + "\r\n\r\n", newline="")
    (folder / "spaced.txt").write_text("\ufeff\n\n" + texts[1].replace("TX", "SX") + "\n", newline="")
    (folder / "broken.txt").write_text("Poker Hand #broken\nTable\n\nnot a hand", newline="")
    (folder / "empty.txt").write_text("")
    (folder / "blank.txt").write_text("\n\n \n")


def table(parsed):
    columns = ["file_name", "hand_id", "tournament_id", "total_pot", "hero_result", F.to_json("actions"), F.to_json("results"), F.to_json("seats")]
    return sorted(tuple(r) for r in parsed.select(*columns).collect())


def test_ranges_equal_whole_texts(spark, tmp_path):
    write(tmp_path / "in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4099", "50000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            blocks = read_hand_blocks(spark, str(tmp_path / "in"), "*.txt")
            if size == "50000":
                tasks = blocks.filter("file_name = 'large.txt'").select(F.spark_partition_id()).distinct().count()
                assert tasks > 8
            assert table(hand_text.parse_blocks(blocks)) == table(hand_text.parse_hands(read_text_files(spark, str(tmp_path / "in"), "*.txt")))
            rows = blocks.filter("file_name = 'large.txt'").orderBy("block_no").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [r.block.split(":")[0] for r in rows] == [hand(i).split(":")[0] for i in range(900)]
        assert len({r.block_no for r in rows}) == 900


def test_rejects_and_empty_folder(spark, tmp_path):
    write(tmp_path / "in")
    (tmp_path / "none").mkdir()
    blocks = read_hand_blocks(spark, str(tmp_path / "in"), "b*.txt")
    assert [(r.file_name, r.block) for r in blocks.collect()] == [("broken.txt", "Poker Hand #broken\nTable")]
    assert read_hand_blocks(spark, str(tmp_path / "none")).collect() == []
