"""Declared pathway sources: loading, checking against the rule file, and findings as rows.

``check(config_path, rules_path)`` returns all findings at once; ``main`` prints them and exits with 0 (consistent),
1 (findings) or 2 (a file can't be read).
"""

from __future__ import annotations

import difflib
import sys
from dataclasses import dataclass, field

from loomgraph.operators.conditioning import PROPAGATING

# Classes a rule may have, of which a config may use the first four, and directions.
USABLE = [*PROPAGATING, "observational", "contextual_constraint"]
KNOWN = [*USABLE, "nonpropagating_context", "nonpropagating"]
FORWARD = "source_to_target"


class ConfigError(ValueError):
    """All findings of a file, one per line."""

    def __init__(self, findings: list[str]):
        self.findings = findings
        super().__init__("\n".join(findings))


@dataclass(frozen=True)
class Source:
    sab: str
    enabled: bool = False
    predicates: tuple[str, ...] = ()
    name_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    gene_sabs: tuple[str, ...] = ("HGNC",)
    excluded_symbols: tuple[str, ...] = field(default=())

    def enabled(self) -> list[Source]:
        return sorted((s for s in self.sources if s.enabled), key=lambda s: s.sab)


def _mapping(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            data = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ConfigError([f"{path}: not YAML: {e}"]) from e
    if not isinstance(data, dict):
        raise ConfigError([f"{path}: expected a mapping at the top, got {type(data).__name__}"])
    return data


def _texts(value: object, where: str, findings: list[str]) -> tuple[str, ...]:
    if value is None:
        return ()
    if not isinstance(value, list) or any(not isinstance(x, str) or not x or x != x.strip() for x in value):
        findings.append(f"{where}: expected a list of names without surrounding blanks")
        return ()
    return tuple(value)


def load_config(path: str) -> Config:
    """Config of a YAML file. Unknown keys, other schema versions, vocabularies with blanks and enabled sources without
    predicates are refused, all in one error."""
    data, bad = _mapping(path), []
    bad += [f"unknown key {k!r}" for k in sorted(set(data) - {"schema_version", "pathway_sources", "gene_sabs", "burden_control_exclusions"})]
    if data.get("schema_version", 1) != 1:
        bad.append(f"schema_version {data['schema_version']!r} is not supported, only 1 is")
    sources = []
    for sab, spec in (data.get("pathway_sources") or {}).items():
        where = f"source {sab!r}"
        if not isinstance(sab, str) or not sab or any(c.isspace() for c in sab):
            bad.append(f"{where}: a vocabulary has no blanks")
        if not isinstance(spec, dict):
            bad.append(f"{where}: expected a mapping")
            continue
        bad += [f"{where}: unknown key {k!r}" for k in sorted(set(spec) - {"enabled", "propagating_predicates_g_to_pw", "kg_name_prefixes"})]
        if not isinstance(spec.get("enabled", False), bool):
            bad.append(f"{where}: enabled must be true or false")
        predicates = _texts(spec.get("propagating_predicates_g_to_pw"), f"{where}: propagating_predicates_g_to_pw", bad)
        if spec.get("enabled") is True and not predicates:
            bad.append(f"{where}: enabled, but without predicates")
        sources.append(Source(str(sab), spec.get("enabled") is True, predicates, _texts(spec.get("kg_name_prefixes"), f"{where}: kg_name_prefixes", bad)))
    genes = _texts(data.get("gene_sabs", ["HGNC"]), "gene_sabs", bad)
    excluded = _texts(data.get("burden_control_exclusions"), "burden_control_exclusions", bad)
    if bad:
        raise ConfigError([f"{path}: {b}" for b in bad])
    return Config(tuple(sources), genes, excluded)


def load_predicates(path: str) -> dict[str, dict]:
    """Predicate rules of a rule file, refused where a section or a rule is malformed."""
    data = _mapping(path)
    edge = data.get("edge_resolution")
    if not isinstance(edge, dict):
        raise ConfigError([f"{path}: edge_resolution is missing or no mapping"])
    rules = edge.get("predicate_to_flow")
    if not isinstance(rules, dict):
        raise ConfigError([f"{path}: edge_resolution.predicate_to_flow is missing or no mapping"])
    bad = [f"{path}: rule of {p!r} needs direction and classification" for p, r in rules.items() if not isinstance(r, dict) or not {"direction", "classification"} <= set(r)]
    if bad:
        raise ConfigError(bad)
    return rules


def hint(predicate: str, known: list[str]) -> str:
    """A predicate that may have been meant: its inverse, or one spelt alike."""
    for other in (f"inverse_{predicate}", predicate.removeprefix("inverse_")):
        if other != predicate and other in known:
            return f"; did you mean {other!r}?"
    near = difflib.get_close_matches(predicate, known, 1, 0.6)
    return f"; did you mean {near[0]!r}?" if near else ""


def cross_check(config: Config, rules: dict[str, dict]) -> list[str]:
    """Every predicate of an enabled source must be known, run from gene to pathway and be of a usable, known class."""
    out = []
    for source in config.enabled():
        for p in source.predicates:
            where = f"source {source.sab!r}: predicate {p!r}"
            rule = rules.get(p)
            if rule is None:
                out.append(f"{where} has no rule{hint(p, list(rules))}")
                continue
            if rule["direction"] != FORWARD:
                out.append(f"{where} has direction {rule['direction']!r}, not {FORWARD!r}{hint(p, list(rules))}")
            if rule["classification"] not in KNOWN:
                out.append(f"{where} has the unknown class {rule['classification']!r}")
            elif rule["classification"] not in USABLE:
                out.append(f"{where} is {rule['classification']!r} and does not propagate")
    return out


def check(config_path: str, rules_path: str) -> list[str]:
    findings, config, rules = [], None, None
    try:
        config = load_config(config_path)
    except ConfigError as e:
        findings += e.findings
    try:
        rules = load_predicates(rules_path)
    except ConfigError as e:
        findings += e.findings
    return findings if config is None or rules is None else cross_check(config, rules)


def main(args: list[str]) -> int:
    if len(args) != 2:
        print("usage: python -m loomgraph.config.pathways CONFIG RULES", file=sys.stderr)
        return 2
    try:
        findings = check(*args)
    except OSError as e:
        print(e, file=sys.stderr)
        return 2
    print("\n".join(findings) or "consistent")
    return int(bool(findings))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
