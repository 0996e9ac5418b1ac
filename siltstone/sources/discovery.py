"""Packages, manifests and the workspace: small questions to the file system, asked on the driver."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from siltstone.operators.manifest_rules import LOCKFILES, MANIFESTS

# Directories that hold no package, and path parts left out when packages are found by themselves.
NOISE = ("__pycache__", "node_modules", "build", "dist", "site-packages")
DEFAULT_EXCLUDES = ("/.venv/", "/venv/", "/.git/", "/__pycache__/", "/node_modules/", "/build/", "/dist/", ".egg-info", "/.mypy_cache/", "/.pytest_cache/", "/.ruff_cache/", "/.tox/", "/site-packages/")
#: This tool's own rule files spell out what they look for.
OWN_RULES = (("siltstone", "operators", "text_rules.py"), ("siltstone", "operators", "ast_rules.py"), ("siltstone", "operators", "manifest_rules.py"), ("siltstone", "operators", "post.py"), ("siltstone", "functions", "facts.py"), ("siltstone", "plans", "corpus.py"))


class UsageError(Exception):
    """A request that cannot be met: exit code 2."""


def is_noise(name: str) -> bool:
    return name.startswith(".") or name in NOISE or name.endswith(".egg-info")


def own_rule_file(path: str) -> bool:
    parts = tuple(path.split("/"))
    return any(parts[-len(p) :] == p for p in OWN_RULES)


def in_scan(path: str, exclude: tuple[str, ...]) -> bool:
    """Whether a file that is there is a source file to look at."""
    return os.path.splitext(path)[1] == ".py" and "__pycache__" not in path and not any(x in path for x in exclude) and not own_rule_file(path)


def python_files(root: str, recursive: bool = True, exclude: tuple[str, ...] = ()) -> list[str]:
    """The ``.py`` files at or below ``root``."""
    if os.path.isfile(root):
        found = [root]
    else:
        found = []
        for base, dirs, names in os.walk(root):
            if not recursive:
                dirs.clear()
            found += [os.path.join(base, n) for n in names]
    return sorted(p for p in found if in_scan(p, exclude))


def has_python(directory: Path) -> bool:
    return any(os.path.splitext(n)[1] == ".py" for _, _, names in os.walk(directory) for n in names)


def discover(cwd: Path) -> tuple[dict[str, str], str | None]:
    """Packages of a directory, and the name of the one that is its loose files (not searched deeper)."""
    try:
        entries = sorted(os.scandir(cwd), key=lambda e: e.name)
    except OSError:
        return {}, None
    packages = {e.name: os.path.join(cwd, e.name) for e in entries if e.is_dir() and not is_noise(e.name) and has_python(Path(e.path))}
    if not any(os.path.splitext(e.name)[1] == ".py" for e in entries):
        return packages, None
    name = Path(os.path.realpath(cwd)).name or str(cwd)
    if name in packages:
        name += " (root)"
    return packages | {name: str(cwd)}, name


def inside(target: str | Path, roots: list[str | Path]) -> bool:
    """Whether an existing path really lies at or below one of ``roots``."""
    if not os.path.exists(target):
        return False
    real = Path(os.path.realpath(target))
    return any(os.path.exists(r) and real.is_relative_to(os.path.realpath(r)) for r in roots)


def _checked(what: str, base: Path, path: str, roots: list) -> str:
    whole = base / path
    if not whole.exists():
        raise UsageError(f"error: {what} is {whole}, which does not exist")
    if not inside(whole, roots):
        raise UsageError(f"error: {what} is {whole}, outside of {', '.join(map(str, roots))}")
    return os.path.realpath(whole)


def packages_from_args(entries: list[str], cwd: Path, workspace: Path | None) -> dict[str, str]:
    """NAME=PATH entries."""
    out = {}
    for entry in entries:
        name, eq, path = (x.strip() for x in entry.partition("="))
        if not (name and eq and path):
            raise UsageError(f"error: --package wants NAME=PATH, not {entry!r}")
        out[name] = _checked(f"--package {entry!r}", cwd, path, [r for r in (workspace, cwd) if r])
    return out


def packages_from_config(config: Path, cwd: Path, workspace: Path | None) -> dict[str, str]:
    """The ``[packages]`` table of a TOML file; its paths start from the file's own directory."""
    try:
        table = tomllib.loads(config.read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise UsageError(f"error: --config {config} cannot be read: {e}") from e
    packages = table.get("packages")
    if not isinstance(packages, dict):
        raise UsageError(f"error: {config} needs a table 'packages' of name = \"path\"")
    base = Path(os.path.realpath(config)).parent
    roots = [r for r in (workspace, cwd, base) if r]
    return {n: _checked(f"package {n!r} of --config", base, p if isinstance(p, str) else "", roots) for n, p in packages.items()}


def resolve(config: Path | None, entries: list[str], cwd: Path, workspace: Path | None) -> dict[str, str]:
    """The config's packages, overlaid by the arguments'."""
    return (packages_from_config(config, cwd, workspace) if config else {}) | packages_from_args(entries, cwd, workspace)


def select(packages: dict[str, str], names: list[str] | None) -> dict[str, str]:
    if names is None:
        return packages
    if unknown := [n for n in names if n not in packages]:
        raise UsageError(f"error: unknown package(s) {', '.join(unknown)}; there are {', '.join(sorted(packages))}")
    return {n: packages[n] for n in names}


def workspace_root(start: Path) -> Path | None:
    """The nearest directory upwards whose pyproject.toml has [tool.uv.workspace]."""
    for d in (start, *start.parents):
        try:
            table = tomllib.loads((d / "pyproject.toml").read_text("utf-8"))
        except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
            continue
        tool = table.get("tool")
        uv = tool.get("uv") if isinstance(tool, dict) else None
        if isinstance(uv, dict) and "workspace" in uv:
            return d
    return None


def manifests(root: str, ceiling: Path | None) -> list[str]:
    """The manifests of the nearest directory upwards that has any, up to the ceiling."""
    here = Path(root)
    for d in (here, *here.parents):
        if found := [str(d / n) for n in MANIFESTS if (d / n).exists()]:
            return found
        if ceiling is not None and d == ceiling:
            break
    return []


def manifest_label(path: str, packages: dict[str, str]) -> str:
    """The package whose root the manifest lies in, else its directory's name."""
    parent = str(Path(path).parent)
    own = [n for n in sorted(packages) if packages[n].rstrip("/") == parent]
    return own[0] if own else Path(parent).name or "root"


def locked(path: str) -> bool:
    """A lock file, or another requirements.txt, beside a manifest."""
    beside = Path(path).parent
    return any((beside / n).exists() for n in LOCKFILES) or (Path(path).name != "requirements.txt" and (beside / "requirements.txt").exists())


def relative(path: str, workspace: Path | None) -> str:
    return os.path.relpath(path, workspace) if workspace and Path(path).is_relative_to(workspace) else path


def file_set(packages: dict[str, str], loose: str | None, exclude: tuple[str, ...], workspace: Path | None) -> dict[str, str]:
    """path to package: the first package by name that reaches a path has it."""
    out: dict[str, str] = {}
    for name in sorted(packages):
        for p in python_files(packages[name], name != loose, exclude):
            out.setdefault(p, name)
        for p in manifests(packages[name], workspace):
            out.setdefault(p, manifest_label(p, packages))
    return out
