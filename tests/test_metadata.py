"""Scene metadata: many documents in a file."""

from gridloom.sources import rasters


def test_many_documents_in_a_file(spark, tmp_path):
    one = 'GROUP = META\n  GROUP = INNER\n  ID = {}\n  NAME = "scene {}"\n  END_GROUP = INNER\nEND\n'
    (tmp_path / "a.txt").write_text("".join(one.format(k, k) for k in range(50)) + "ID =\nOTHER = 7\nEND\nOTHER = 8\nEND\n")
    (tmp_path / "b.txt").write_text("\tID\t= 99  \r\n")
    got = {(r.ID, r.NAME) for r in rasters.key_values(spark, str(tmp_path), ["ID", "NAME"]).collect()}
    assert got == {(str(k), f"scene {k}") for k in range(50)} | {("", None), ("99", None)}


def test_xml_with_its_schema(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<p>" + "".join(f"<scene><id>{k}</id><name>n{k}</name></scene>\n" for k in range(50)) + "</p>")
    got = rasters.xml_rows(spark, str(tmp_path), "scene", "id bigint, name string")
    assert got.dtypes == [("id", "bigint"), ("name", "string")] and sorted(map(tuple, got.collect())) == [(k, f"n{k}") for k in range(50)]
