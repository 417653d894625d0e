from cytofleet.operators import cells as D


def test_profile_has_every_scalar_and_one_row_per_cell(disk_field):
    px, lab, f = disk_field
    names = ["glycocalyx", "yap", "paxillin", "actin"]
    p = D.expand_profile(D.assemble_profiles(px, lab, f, names)).toPandas().set_index("cell_id")
    scalars = [c for c in p.columns if c != "field_id" and "radial_profile" not in c]
    assert len(scalars) == 51 and sum("radial_profile" in c for c in p.columns) == 20
    assert sorted(p.index) == [1, 2, 3, 4, 5]
    assert (abs(p["yap_nc_ratio"] - 2) < 1e-9).all() and p["glycocalyx_pericellular_ratio"].isna().all()
    assert (p["fa_count"] > 0).all() and (p["actin_mean_intensity"] == 1).all() and (p["nuclear_area"] < p["cell_area"]).all()


def test_absent_channels_are_skipped_and_an_empty_mask_is_empty(disk_field):
    px, lab, f = disk_field
    p = D.assemble_profiles(px, lab, f, ["yap"])
    assert not [c for c in p.columns if c.startswith(("fa_", "actin_", "glycocalyx_"))] and p.count() == 5
    assert D.assemble_profiles(px, lab.filter("false"), f, ["yap"]).isEmpty()


def test_embedding_width_is_checked(spark):
    import pytest

    cells = spark.createDataFrame([(1, 1), (1, 2)], "field_id int, cell_id int")
    e = spark.createDataFrame([(1, 1, [1.0, 2.0])], "field_id int, cell_id int, embedding array<float>")
    got = {r["cell_id"]: r["embedding"] for r in D.attach_embeddings(cells, e, 2).collect()}
    assert got == {1: [1.0, 2.0], 2: None}
    with pytest.raises(Exception, match="width"):
        D.attach_embeddings(cells, e, 3).collect()
