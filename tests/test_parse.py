"""BibTeX, LaTeX and paper folders."""

import json

import pytest

from refweave.plans import linkage
from refweave.sources import bibtex, latex, papers

MAIN = r"""\documentclass{article}
\title{On \textbf{Things}} % remark
\begin{document}
\maketitle
\begin{abstract}We study things. They matter, e.g. a lot.\end{abstract}
\section{Intro}
First one. Second $x. Y$ one \cite{b,a}.
\begin{itemize}\item one \item[x] two\end{itemize}
\input{sec/next}
\begin{figure}[t]\caption{A \emph{picture}.}\end{figure}
\begin{equation}\label{e} a=b \end{equation}
\section{References}
Hidden text.
\begin{thebibliography}{9}
\bibitem{a} A. Smith, ``Deep nets,'' J. Things, 2019, pp. 3--9, arXiv:1901.00001.
\bibitem{b} A. Smith, ``Deep nets,'' J. Things, 2019, pp. 3--9, arXiv:1901.00001.
\bibitem[L]{z} Not taken.
\end{thebibliography}
\end{document}
Never.
"""
BIB = r"""@string{x = "y"}
@article{k1, title = {Deep {GPU} Nets}, author = "Ann Lee and Bo Chen", year = 2020, eprint={2001.00002}, title={Deep {GPU} Nets of Lee}}
@book{k2, title={Nope}}
@article {k3, title={Blank}}
@misc{k4, note={C. Dee, Walking the graph, 1999, somewhere}}
"""


def test_bib():
    got = {e["key"]: e for e in bibtex.bib_entries(BIB)}
    assert set(got) == {"k1", "k2", "k4"} and got["k1"]["title"] == "Deep {GPU} Nets of Lee" and got["k1"]["arxiv"] == "2001.00002" and got["k4"]["author"] == "C. Dee"
    assert [e.split("{")[0] for e in bibtex.stripped_entries("% x\n" + BIB)] == ["@article", "@book", "@article ", "@misc"]


def test_bibitems():
    items = list(bibtex.bibitems(MAIN))
    assert [k for k, _ in items] == ["a", "b"]
    fields, alias = bibtex.canonical(items)
    assert alias == {"a": "a", "b": "a"} and fields["a"]["year"] == "2019" and fields["a"]["arxiv"] == "1901.00001" and fields["a"]["title"].startswith("Deep nets")
    assert bibtex.remap_cites(r"\citep[p. 1]{b, a,c}", alias) == r"\citep[p. 1]{a,c}"
    assert "@misc{a," in bibtex.refs_bib(["@article{q,x}"], fields) and "@misc{a," not in bibtex.refs_bib(["@article{a,x}"], fields)
    assert bibtex.bibitem_fields("", "SmithJones20")["author"] == "Smith Jones"


def test_includes_and_main():
    files = {"main.tex": r"\includeonly{b}\include{a}\include{b}\input{main}", "a.tex": "A", "b.tex": "B"}
    assert latex.main_file(files) == "main.tex" and latex.inline_includes("main.tex", files).endswith("B")
    assert latex.main_file({"x.tex": "", "y.tex": r"\documentclass{a}"}) == "y.tex" and latex.main_file({"x.tex": ""}) is None
    assert latex.sentences("By A. Smith et al. See Fig. 2 here. New one! Last") == ["By A. Smith et al.", "See Fig. 2 here.", "New one!", "Last"]


@pytest.fixture
def root(tmp_path):
    one = tmp_path / "2001-1" / "tex"
    (one / "v1" / "sec").mkdir(parents=True)
    (one / "v1" / "main.tex").write_text(MAIN)
    (one / "v1" / "sec" / "next.tex").write_text("\\subsection{Inner}\nIncluded sentence.\n")
    (one / "v1" / "r.bib").write_text(BIB)
    (one / "v2").mkdir()
    (one / "v2" / "main.tex").write_text(MAIN)
    (one / "v2" / "r.bib").write_text(BIB)
    refs = {"1901-1": {"paper_title": "Deep Nets", "authors": ["A. Smith"], "submission_date": "2019-01-02"}, "1901-2": {"paper_title": None, "authors": None, "submission_date": None}}
    (one.parent / "references.json").write_text(json.dumps(refs))
    two = tmp_path / "2001-2" / "tex" / "v1"
    two.mkdir(parents=True)
    (two / "main.tex").write_text("no structure at all.")
    (tmp_path / "2001-2" / "references.json").write_text("{broken")
    return str(tmp_path)


def test_folder(spark, root):
    out = linkage.parse(spark, root)
    assert out["skipped"].count() == 0
    bib = {r["key"]: r for r in out["bibitems"].collect()}
    assert set(bib) == {"k1", "k4", "a"} and bib["k1"]["title_tokens"] == ["deep", "gpu", "nets"] and bib["k1"]["authors_norm"] == ["ann lee", "bo chen"]
    assert bib["k4"]["tokens_source"] == "note" and "graph" in bib["k4"]["title_tokens"]
    refs = {r["id"]: r for r in out["references"].collect()}
    assert refs["1901-1"]["year"] == "2019" and refs["1901-1"]["title_tokens"] == ["deep", "nets"] and refs["1901-2"]["title"] == ""
    elements, edges = papers.hierarchy_tables(out["parsed"])
    texts = {r["text"] for r in elements.where("paper_id = '2001-1'").collect()}
    assert {"On Things", "Abstract", "Intro", "Inner", "Included sentence.", "one", "two", "A picture."} <= texts and "Hidden text." not in texts and not any("Never" in t for t in texts)
    assert edges.where("paper_id = '2001-1'").select("version").distinct().count() == 2
    assert [r["paper_id"] for r in papers.paper_list(papers.paper_files(spark, root), start="2001-2").collect()] == ["2001-2"]
    with pytest.raises(ValueError):
        papers.paper_list(papers.paper_files(spark, root), paper_id="x")


def test_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"paper_id": "p1", "key": "k"}\nbroken\n{"key": "x"}\n\n')
    assert papers.read_bibitems(spark, str(tmp_path / "b.jsonl")).count() == 1
    assert papers.malformed(spark, str(tmp_path / "b.jsonl"), "paper_id string, key string") == 1
    (tmp_path / "m.json").write_text('{"p1": {"k": "r", "l": "s"}}')
    assert papers.read_manual(spark, str(tmp_path / "m.json")).count() == 2 and papers.read_manual(spark, None).count() == 0
    rows = spark.createDataFrame([("p1", "k", "r", 1, "train"), ("p2", "k", "r", 0, "val"), ("p3", "k", "r", 0, "test")], "paper_id string, bib_key string, cand_id string, label int, partition string")
    papers.write_split(rows, str(tmp_path / "split"))
    assert {(r["paper_id"], r["partition"]) for r in papers.read_split(spark, str(tmp_path / "split")).collect()} == {("p1", "train"), ("p2", "val"), ("p3", "test")}


def test_stream(spark, tmp_path):
    from refweave.streaming import normalize

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"paper_id": "p", "title_tokens": ["the", "deep", "lee"], "authors_norm": [" Ann Lee "], "author_tokens": []}) + "\n")
    normalize.start(normalize.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["title_tokens"] == ["deep"] and row["author_tokens"] == ["ann", "lee"]


def test_tex_tree_takes_all_documents(spark, tmp_path):
    from refweave.plans import queries

    texts = {i: f"Alpha {i} stands here. Beta {i} ends." for i in [0, 1, 39, 40, 199, 200, 201, 399, 4000]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["tex_tree"](spark, str(tmp_path)).collect()
    text = {r["id"]: r["text"] for r in got}
    found = {(r["paper_id"], text.get(r["parent"]), r["text"]) for r in got}
    plain = set()
    for i, body in texts.items():
        paper, title = f"p{i // 40:05d}", f"Document {i}"
        plain |= {(paper, None, ""), (paper, "", title)} | {(paper, title, x) for x in (body.split(". ")[0] + ".", body.split(". ")[1])}
    assert found == plain


def test_lists_with_equal_beginnings_stay_apart():
    tree, start = latex.Tree("p"), "the same long words " * 5
    latex.parse_document(tree, "".join(rf"\section{{{x}}}\begin{{itemize}}\item {start}{x}\end{{itemize}}" for x in ("One", "Two")))
    lists = [i for i in tree.elements if "::list_" in i]
    assert len(lists) == 2 and {tree.elements[i] for i in lists} == {"itemize"} and all(len(tree.children[i]) == 1 for i in lists)
    assert len({tree.parents()[i] for i in lists}) == 2


def test_bibitems_are_told_apart_by_all_letters():
    items = [("a", "Иванов, Теория поля 2001"), ("b", "Петров, Алгебра 2001"), ("c", "Иванов, \\emph{Теория} поля, 2001"), ("d", "")]
    fields, alias = bibtex.canonical(items)
    assert alias == {"a": "a", "b": "b", "c": "a", "d": "d"} and fields["a"]["author"] == "Иванов" and fields["a"]["authors"] == ["Иванов"]
    one = bibtex.bibitem_fields(r'A. Smith. "Deep \emph{nets}" \newblock {\em J. X} 12--14, 2020', "k")
    assert one["author"] == "A. Smith" and one["title"] == "Deep nets" and "newblock" not in one["note"] and one["pages"] == "12--14"
    assert bibtex.misc_entry("k", {"author": "A", "title": "T", "note": "N", "arxiv": "2001.00001", "year": "2020", "pages": "", "doi": ""}) == "@misc{k,\n  title = {T},\n  author = {A},\n  year = {2020},\n  eprint = {2001.00001},\n  archivePrefix = {arXiv},\n  note = {N}\n}\n"


def test_bib_fields_by_hand():
    assert bibtex.bib_fields('title = {A {B} c}, author="X \\"Y\\" Z" , year=2020\n, odd, note = {n}} rest = {x}') == {"title": "A {B} c", "author": 'X \\"Y\\" Z', "year": "2020", "note": "n"}
    assert bibtex.bib_fields("a = {never closed") == {"a": "never close"} and bibtex.bib_fields("a = ") == {} and bibtex.bib_fields("}") == {}
    got = list(bibtex.stripped_entries("junk\n% @x{a}\n@string{s = {x}}\nsee @misc{a, % note\n title={T}}\n@article{b,\n x={}\n}\n"))
    assert got == ["see @misc{a, \n title={T}}", "@article{b,\n x={}\n}"]


def test_versions_items_and_floats():
    version = {"main.tex": MAIN, "r.bib": BIB}
    out = papers.parse_one("p", {"v1": {"r.bib": "@misc{lost, note={x}}", "notes.tex": "nothing"}, "v2": version})
    tree = json.loads(out["hierarchy"])
    assert tree["hierarchy"]["1"] == {} and tree["hierarchy"]["2"] and "lost" not in out["refs_bib"] and out["n_versions"] == 2
    t = latex.Tree("p")
    latex.parse_document(t, r"\begin{document}\section{S}\begin{itemize}\item One here. Two $x$ here. \begin{equation} a \nonumber \end{equation}\item B \begin{itemize}\item Inner\end{itemize}\end{itemize}\begin{figure}\includegraphics[w]{f}Plain \textbf{body}\label{x}\end{figure}\end{document}")
    texts = {v: t.elements[t.parents()[k]] for k, v in t.elements.items() if k in t.parents()}
    assert texts["One here."].startswith("One here. Two") and texts["Inner"] in ("itemize", "Inner") and r"\begin{equation}a\end{equation}" in texts and texts["Plain body"] == "S"
    assert latex.sentences('He wrote "Yes." "No." he said. See $x$. (In all.) A. B. Smith etc. Here') == ['He wrote "Yes." "No." he said.', "See $x$. (In all.) A. B. Smith etc. Here"]


def test_papers_without_tex_and_merged_bib(spark, root, tmp_path):
    import pathlib

    (pathlib.Path(root) / "2001-3").mkdir()
    (pathlib.Path(root) / "2001-3" / "refs.bib").write_text("@misc{own, title={Own: a/b Title}, author={Ann Lee and De/Fo X}}\n@misc{own, title={Again}}\n")
    out = linkage.parse(spark, root)
    rows = [r for r in out["bibitems"].collect() if r["paper_id"] == "2001-3"]
    assert sorted(r["title_tokens"] for r in rows) == [["again"], ["own", "title"]]
    assert [r["authors_norm"] for r in rows if r["title_tokens"] != ["again"]] == [["ann lee", "de/fo x"]]
    merged = bibtex.merged_bib(papers.paper_files(spark, root).where("path like '%.bib' and version is not null")).collect()
    assert [r["paper_id"] for r in merged] == ["2001-1"] and merged[0]["content"].count("@article{k1") == 2 and "@string" not in merged[0]["content"]
    assert papers.read_manual(spark, str(tmp_path / "none.json")).count() == 0


def test_title_and_note_marks(spark):
    files = spark.createDataFrame([("p", "@misc{a, author={Ann Lee}, title={Graph/tree: nets}, note={See: here}}\n@misc{b, author={Ann Lee}, note={See: here/ now 1999 end}}")], "paper_id string, content string")
    rows = {r["key"]: r for r in papers.bibitem_rows(bibtex.parse_bib(files)).collect()}
    assert rows["a"]["note_norm"] == "see here" and rows["a"]["title_tokens"] == ["graph", "tree", "nets"]
    assert rows["b"]["tokens_source"] == "note" and rows["b"]["title_tokens"] == ["see", "here", "now"]


def test_includes_by_name_and_safe_paths():
    files = {"main.tex": r"\includeonly{sec/b}\include{sec/a}\include{sec/b}\include{b}\import{sec/}{c}\input{./sec/../d}", "sec/a.tex": "A", "sec/b.tex": "B", "b.tex": "TOP", "sec/c.tex": "C\\input{e}", "sec/e.tex": "E", "d.tex": "D"}
    assert latex.inline_includes("main.tex", files) == "BCED" and latex.inline_includes("main.tex", files | {"main.tex": r"\includeonly{b}\include{sec/b}"}) == "B"
    assert latex.safe_parts("../a/./b.tex") == ["a", "b.tex"] and latex.include_name(" {x/y.tex} ") == "x/y"


def test_whole_entries_and_items(spark):
    got = list(bibtex.whole_entries("@article {k, year=2020, title = {A\n  B}}\n@misc{nokey}\n"))
    assert got == [{"title": "A B", "year": "2020", "key": "k", "raw": "@article {k, year=2020, title = {A B}}"}]
    rows = papers.bibitem_rows(bibtex.parse_items(spark.createDataFrame([("p", MAIN), ("q", None)], "paper_id string, content string"))).collect()
    assert sorted((r["paper_id"], r["key"], r["year"]) for r in rows) == [("p", "a", "2019"), ("p", "b", "2019")] and rows[0]["title_tokens"] == ["deep", "nets"]


def test_elements_in_one_pass_equal_the_two_tables(spark):
    tex = "\\documentclass{article}\\begin{document}\\section{One}\nA first. B second.\n%s\\end{document}"
    rows = [("p1", "v1", "main.tex", tex % ""), ("p1", "v2", "main.tex", tex % "\\section{Two}\nB second. C\u2003third."), ("p2", "v1", "main.tex", tex % "D."), ("p2", "v2", "x.bib", ""), ("p3", None, "refs.bib", "")]
    files = spark.createDataFrame([(a, b, c, d.encode()) for a, b, c, d in rows], "paper_id string, version string, path string, content binary")
    elements, edges = papers.hierarchy_tables(papers.parse_papers(files))
    joined = elements.join(edges, [elements.paper_id == edges.paper_id, elements.id == edges.child], "left").select(elements.paper_id, "id", "parent", "text")
    made = papers.paper_elements(files)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(made) == order(joined) and made.where("parent is null").count() == 2 and made.where("text = 'B second.'").count() == 3
    assert made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroups") == 1
