import pytest
import sample

from pagewright import cli


def test_ingest_and_build(spark, tmp_path, capsys):
    (tmp_path / "fixtures").mkdir()
    (tmp_path / "fixtures" / "nova.html").write_text(sample.page(), encoding="utf-8")
    root = ["--root", str(tmp_path)]
    assert cli.main([*root, "ingest", "missing"]) == 1
    assert cli.main([*root, "build", "--all"]) == 1
    assert cli.main([*root, "ingest", "nova"]) == 0
    file = tmp_path / "corpus" / "benedict-xvi" / "nova.md"
    assert file.read_text(encoding="utf-8").startswith("---\ntitle_slug: nova\n")
    assert cli.main([*root, "ingest", "nova"]) == 1 and cli.main([*root, "ingest", "nova", "--force"]) == 0
    assert cli.main([*root, "build", "nova"]) == 0
    assert '#section-heading("Introduction")' in (tmp_path / "output" / "2001-03-25-benedict-xvi-nova.typ").read_text(encoding="utf-8")


    assert (tmp_path / "templates" / "default.typ").exists() and "#let signature(" in (tmp_path / "templates" / "lib" / "typography.typ").read_text()


def test_arguments(tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["fetch", "http://a", "http://b", "--slug", "x"])
    with pytest.raises(SystemExit):
        cli.main(["build"])
    with pytest.raises(SystemExit):
        cli.main(["--version"])
