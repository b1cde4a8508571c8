from tarn.__main__ import arguments, run


def out(spark, *argv):
    return run(spark, arguments().parse_args([str(a) for a in argv]))


def test_commands(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("The cat, the hat.")
    (docs / "b.txt").write_text("A cat sat")
    assert out(spark, "tokens", "-f", docs / "a.txt", "-cf", "-rp") == ["the", "cat", "the", "hat"]
    assert out(spark, "tokens", "-f", docs / "a.txt", "-p", "none") == ["The", "cat", ",", "the", "hat", "."]
    assert out(spark, "kgrams", "-f", docs, "-k", 2, "-kg", "at ^c") == ["1 terms", "cat"]
    assert out(spark, "index", "-d", docs, "-o", tmp_path / "index") == ["2 documents"]
    assert out(spark, "search", "-i", tmp_path / "index", "hat")[0].endswith("a.txt   0.17329")
    assert out(spark, "search", "-i", tmp_path / "index", "cat sat", "--kind", "phrase")[0].split()[-1] == "2.00000"
    assert out(spark, "search", "-i", tmp_path / "index", "haat", "--kind", "intersection")[1] == "hat"
    (tmp_path / "links").write_text("0;1\n1;0\n2;0\n")
    (tmp_path / "titles").write_text("0;a.txt\n")
    assert out(spark, "pagerank", tmp_path / "links", "--titles", tmp_path / "titles", "-n", 1)[0].endswith(": a.txt")
    assert len(out(spark, "pagerank", tmp_path / "links", "--walks", 300, "--complete")) == 3
    assert out(spark, "hits", tmp_path / "links", "-n", 1)[2] == "authorities"
