import pytest
import yaml

from loomgraph.config import pathways as p
from loomgraph.config import provenance as v

GOOD = {"schema_version": 1, "pathway_sources": {"MSIGDB": {"enabled": True, "propagating_predicates_g_to_pw": ["inverse_x"], "kg_name_prefixes": ["H_"]}, "GO": {"enabled": False}}, "gene_sabs": ["HGNC"], "burden_control_exclusions": ["TTN"]}
RULES = {"edge_resolution": {"predicate_to_flow": {"inverse_x": {"direction": "source_to_target", "classification": "mechanistic"}}}}


def files(tmp_path, config, rules):
    out = []
    for name, data in (("config", config), ("rules", rules)):
        f = tmp_path / f"{name}.yaml"
        f.write_text(data if isinstance(data, str) else yaml.safe_dump(data))
        out.append(str(f))
    return out


def with_(**changes):
    return GOOD | changes


def source(**changes):
    return with_(pathway_sources={"MSIGDB": GOOD["pathway_sources"]["MSIGDB"] | changes})


def rule(**changes):
    return {"edge_resolution": {"predicate_to_flow": {"inverse_x": RULES["edge_resolution"]["predicate_to_flow"]["inverse_x"] | changes}}}


def test_a_consistent_pair(tmp_path, capsys):
    pair = files(tmp_path, GOOD, RULES)
    assert p.check(*pair) == [] and p.main(pair) == 0
    config = p.load_config(pair[0])
    assert [s.sab for s in config.enabled()] == ["MSIGDB"] and config.excluded_symbols == ("TTN",)


@pytest.mark.parametrize(
    ("config", "rules", "parts"),
    [
        (with_(extra=1), RULES, ["unknown key 'extra'"]),
        (with_(schema_version=999), RULES, ["schema_version 999"]),
        (source(propagating_predicates_g_to_pw=[]), RULES, ["without predicates"]),
        (source(propagating_predicates_g_to_pw=[" x"]), RULES, ["surrounding blanks", "without predicates"]),
        (source(odd=1), RULES, ["unknown key 'odd'"]),
        (with_(pathway_sources={"MSIGDB BAD": {"enabled": False}}), RULES, ["no blanks"]),
        ("[1, 2]", RULES, ["expected a mapping"]),
        (": : :", RULES, ["not YAML"]),
        (GOOD, "text", ["expected a mapping"]),
        (GOOD, {"x": 1}, ["edge_resolution is missing"]),
        (GOOD, {"edge_resolution": {}}, ["predicate_to_flow is missing"]),
        (GOOD, {"edge_resolution": {"predicate_to_flow": {"inverse_x": "?"}}}, ["needs direction"]),
        (GOOD, rule(direction="target_to_source"), ["has direction"]),
        (GOOD, rule(classification="nonpropagating_context"), ["does not propagate"]),
        (GOOD, rule(classification="odd"), ["unknown class"]),
        (GOOD, rule(direction="bidirectional", classification="odd"), ["has direction", "unknown class"]),
        (source(propagating_predicates_g_to_pw=["x", "inverse_xx"]), RULES, ["no rule; did you mean 'inverse_x'", "no rule; did you mean 'inverse_x'"]),
    ],
)
def test_all_findings_come_at_once(tmp_path, config, rules, parts):
    pair = files(tmp_path, config, rules)
    found = p.check(*pair)
    assert len(found) == len(parts) and all(x in f for x, f in zip(parts, found, strict=True)), found
    assert p.main(pair) == 1


def test_unreadable_files_and_usage(tmp_path):
    assert p.main([str(tmp_path / "none"), str(tmp_path / "none")]) == 2
    assert p.main([]) == 2


def test_provenance(tmp_path):
    full = {s: dict.fromkeys(keys, "x") for s, keys in v.REQUIRED.items()}
    assert v.status(full) == "COMPLETE" and v.status({}) == v.status(None) == "INCOMPLETE"
    part = full | {"cohort": full["cohort"] | {"name": None}}
    assert v.status(part) == "PARTIAL" and v.missing(part) == ["cohort.name"]
    assert "- name: not specified" in v.markdown(part)
    f = tmp_path / "p.yaml"
    f.write_text(yaml.safe_dump(part | {"pipeline": None}))
    assert v.load(str(f))["pipeline"]["python_version"]
    assert v.record_command(str(tmp_path), ["a"], {"alpha": 0.5}).exists()


def test_markdown_table(spark):
    df = spark.createDataFrame([("a|b", 0.123456, None)], "x string, y double, z int")
    assert v.table(df, 5).splitlines() == ["| x | y | z |", "| --- | --- | --- |", "| a\\|b | 0.1235 |  |"]
