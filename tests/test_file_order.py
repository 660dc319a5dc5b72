"""Article lines of several files are numbered by file and line, however Spark deals the files out."""

from linkweave.sources import corpus


def test_lines_go_by_file(spark, tmp_path):
    """Spark reads the largest file first; a later, larger file must not come first."""
    folder = tmp_path / "articles.jsonl"
    folder.mkdir()
    n = 0
    for f, size in enumerate((3, 400, 50)):
        (folder / f"part-{f}.json").write_text("".join(f'{{"id":"{n + k}","title":"t{n + k}"}}\n' for k in range(size)))
        n += size
    rows = corpus.read_states(spark, str(folder)).orderBy("seq").select("seq", "id").collect()
    assert [(r[0], r[1]) for r in rows] == [(k, str(k)) for k in range(n)]
