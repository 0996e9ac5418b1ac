"""Every case from files on disk to the JSON report, by the command line: each file must have its findings and no others."""

import json

from siltstone.cli import main
from siltstone.plans.corpus import TEMPLATES
from siltstone.plans.registry import NUMBER, VARIANTS
from tests.test_rules import CASES

#: Lines of templates whose marker takes their finding away: (part of the line, id).
SILENCED = (("eval(a)  # nosec", "CWE-94"), ("# nosec CWE-502,CWE-94", "CWE-502"), ("# NOSEC: fine", "CWE-770"))


def written(root, cases):
    """A package for each case, named by a config file."""
    lines = ["[packages]"]
    for k, (name, text) in enumerate(cases):
        d = root / f"g{k}"
        d.mkdir()
        (d / name).write_bytes(text.encode())
        lines.append(f'g{k} = "g{k}"')
    (root / "cases.toml").write_text("\n".join(lines))
    return root / "cases.toml"


def report(spark, root, config, *more):
    out = root / "report.json"
    main(["--json", "--config", str(config), "--output", str(out), "--include-tests", *more], spark, root)
    return json.loads(out.read_text())


def test_templates_from_disk(spark, tmp_path):
    cases = [(t.name or "m.py", t.text) for t in TEMPLATES]
    got = report(spark, tmp_path, written(tmp_path, cases))
    want, silenced = [], 0
    for k, t in enumerate(TEMPLATES):
        for e in t.expected if not t.name.endswith(".pth") else ():
            line = t.text.split("\n")[e.line - 1]
            if any(part in line and e.cwe == cwe for part, cwe in SILENCED):
                silenced += 1
                continue
            want.append((f"g{k}", e.line, e.cwe, e.severity, e.confidence, e.code))
    assert sorted((f["package"], f["line"], f["cwe_id"], f["severity"], f["confidence"], f["code"]) for f in got["findings"]) == sorted(want)
    assert got["count"] == len(want) > 100 and got["nosec_suppressed"] == silenced == 3


def test_cases_from_disk(spark, tmp_path):
    cases = [c for c in CASES if c[1] in ("a.py", "x.py", "setup.py", "requirements.txt", "pyproject.toml", "Pipfile")]
    got = report(spark, tmp_path, written(tmp_path, [(n, t) for _, n, t, _ in cases]))
    ids = {c: {v.cwe for v in VARIANTS if v.check == c} for c in {c for c, *_ in cases}}
    for k, (check, _, text, want) in enumerate(cases):
        own = [f"{f['severity']} {f['confidence']} {f['line']}" for f in got["findings"] if f["package"] == f"g{k}" and f["cwe_id"] in ids[check]]
        missing = [w for w in want if w not in own]
        assert not missing, (check, text, own)
    order = [(f["package"], f["line"]) for f in got["findings"]]
    assert len(order) == got["count"] and len(NUMBER) == len(VARIANTS)


def test_report_is_in_order_of_paths(spark, tmp_path):
    got = report(spark, tmp_path, written(tmp_path, [("b.py", "eval(a)"), ("a.py", "exec(b)\neval(c)")]))
    assert [(f["package"], f["line"]) for f in got["findings"]] == [("g0", 1), ("g1", 1), ("g1", 2)]
