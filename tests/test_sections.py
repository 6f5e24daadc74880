"""Markdown sections against a line-by-line restatement."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.operators.sections import doc_sections, section_documents
from threadloom.sources.files import doc_files

LINE = st.sampled_from([
    "# One", "## Two  ", "###### Six", "####### seven", "#x", "#", "# ", "#  ", "#\tTab", "# # x",
    "text", "", "   ", "```", " # indented", "#　wide", "# \r", "é # x", "#\x1cfs",
])


def restated(stem, text):
    sections, number = [(0, 0, stem, "")], 0
    for row in text.split("\n"):
        match = re.match(r"^(#{1,6})\s+(.+)$", row)
        if match:
            number += 1
            sections.append((number, len(match.group(1)), match.group(2).strip(), ""))
        else:
            sections[-1] = (*sections[-1][:3], sections[-1][3] + row + "\n")
    return [s for s in sections if s[3].strip()]


def sections_of(spark, text):
    files = spark.createDataFrame([("/r/docs/source/a/b/guide.v2.md", text)], "path string, value string")
    rows = doc_sections(files).orderBy("section_no").collect()
    assert all(r["path"] == "a/b/guide.v2.md" for r in rows)
    return [(r["section_no"], r["level"], r["title"], r["content"]) for r in rows]


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINE, max_size=12).map("\n".join))
def test_sections(spark, text):
    assert sections_of(spark, text) == restated("guide.v2", text)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    deep = root / "docs" / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "one.md").write_bytes(b"intro text that is long enough to be kept, surely it is\r\n# T\r\nbody")
    (deep / "two.rst").write_text("# Title\n" + "x" * 41 + "\n# Title\n" + "y" * 40 + "\n")
    (deep / "bad.md").write_bytes(b"# A\n\xff\xfe" + b"z" * 80)
    (deep / "skip.txt").write_text("# A\n" + "z" * 80)
    (root / "docs" / "top.md").write_text("")
    return str(root)


def test_tree(spark, tree):
    rows = doc_sections(doc_files(spark, tree)).orderBy("path", "section_no").collect()
    assert [(r["path"], r["title"], r["content"]) for r in rows] == [
        ("a/b/one.md", "one", "intro text that is long enough to be kept, surely it is\n"),
        ("a/b/one.md", "T", "body\n"),
        ("a/b/two.rst", "Title", "x" * 41 + "\n"),
        ("a/b/two.rst", "Title", "y" * 40 + "\n\n"),
    ]


def test_short_documents_are_dropped(spark, tree):
    made = section_documents(doc_sections(doc_files(spark, tree)), positional_ids=True)
    rows = made.orderBy("id").collect()
    # "# Title\n\n" is 9 characters long: 50 stay, 49 go.
    assert [(r["id"], len(r["document"])) for r in rows] == [("wpilib_doc_0", 62), ("wpilib_doc_1", 50)]
    assert rows[1]["metadata"]["title"] == "Title" and rows[1]["metadata"]["file_path"] == "a/b/two.rst"
    assert rows[1]["metadata"]["type"] == "wpilib_documentation"


def test_missing_tree(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        doc_files(spark, str(tmp_path))


def test_source_wins_over_docs(spark, tmp_path):
    for name in ("source", "docs"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.md").write_text("x")
    assert [r["path"].split("/")[-1] for r in doc_files(spark, str(tmp_path)).collect()] == ["source.md"]
