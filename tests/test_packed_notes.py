"""Many small notes: tasks do not wait for each other in one folder, and few tasks read them."""

import os

from quillspark.sources import notes


def test_small_notes_share_tasks(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/vault"
    rows = [(f"papers/{i}.md", f"text {i}") for i in range(600)]
    notes.write(spark.createDataFrame(rows, "name string, text string"), path)
    monkeypatch.setattr(notes, "PACKED", 4, raising=False)
    got = notes.read(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    assert got.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, -(-plain.rdd.getNumPartitions() // 4)) < plain.rdd.getNumPartitions()


def test_a_task_makes_files_in_a_folder_of_its_own(tmp_path):
    writer = notes.NotesWriter(f"file://{tmp_path}/vault", ["name", "text"], True)
    seen = []

    def rows():
        for i in range(3):
            yield {"name": f"papers/{i}.md", "text": "x"}
            seen.append(sorted(os.listdir(f"{opened}/papers")))

    opened = writer.staging.removeprefix("file://")
    done = writer.write(rows())
    assert seen == [["0.md"], ["0.md", "1.md"], ["0.md", "1.md", "2.md"]] and len(os.listdir(f"{opened}-passing")) == 1
    writer.commit([done])
    assert os.listdir(tmp_path) == ["vault"] and sorted(os.listdir(f"{tmp_path}/vault/papers")) == ["0.md", "1.md", "2.md"]


def test_the_driver_holds_no_list_of_notes(spark, tmp_path):
    path = f"file://{tmp_path}/vault"
    rows = [(f"papers/{i}.md", f"text {i}") for i in range(40)] + [("papers/_a.md", "a"), ("_b/c d%20.md", "é")]
    notes.write(spark.createDataFrame(rows, "name string, text string"), path)
    got = notes.read(spark, path)
    assert got.inputFiles() == []
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    (tmp_path / "vault" / ".hidden").mkdir()
    (tmp_path / "vault" / ".hidden" / "x.md").write_text("x")
    assert got.count() == len(rows)
