"""Paths of the registered licence query."""

from sightline.llm import licences

FOLDER = "/root/testdata/sf0.1"  # the smaller ones have no notice in a short document


def test_some_documents_inherit_from_a_higher_directory(spark):
    rows = licences.op9_licence_inheritance(spark, FOLDER).collect()
    path = {r.doc_id: r.path.rsplit("/", 1)[0] for r in rows}
    assert {p.count("/") for p in path.values()} == {1, 2, 3}
    assert any(r.basis == "inherited" and len(path[r.inherited_from]) < len(path[r.doc_id]) for r in rows)
