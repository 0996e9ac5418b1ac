"""The 14 syntax checks as filters over the events of ``functions.facts``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.operators.rules import Variant

# Names that the checks look for.
RANDOM = ("random", "randint", "choice", "uniform", "shuffle", "sample", "randrange")
HTTP = ("get", "post", "put", "patch", "delete", "head", "options", "request")
DECODERS = ("base64.b64decode", "base64.urlsafe_b64decode", "base64.decodestring", "zlib.decompress", "bz2.decompress", "codecs.decode")
HUB = ("from_pretrained", "load_dataset", "pipeline")

Test = Callable[[Column], Column]
_UNTRUSTED = "Deserialization of Untrusted Data"


def _v(check: str, cwe: str, name: str, severity: str, detail: str, confidence: str = "HIGH") -> Variant:
    return Variant(check, cwe, name, severity, detail, None, confidence)


def _last(e: Column) -> Column:
    return F.substring_index(e["name"], ".", -1)


def _call(e: Column) -> Column:
    return e["kind"] == "call"


def _hub(e: Column) -> Column:
    return _call(e) & _last(e).isin(*HUB)


_trusts = lambda e: F.array_contains(e["true_keywords"], "trust_remote_code")
_pandas = lambda e: e["name"].isin("pandas.eval", "pd.eval")

#: For each check, variants with their tests in order: of one check, the first that holds fires for an event.
AST_CHECKS: tuple[tuple[str, tuple[tuple[Variant, Test], ...]], ...] = (
    (
        "check_eval_exec",
        (
            (_v("check_eval_exec", "CWE-94", "Code Injection", "CRITICAL", "Text is run as code."), lambda e: _call(e) & e["name"].isin("eval", "exec")),
            (_v("check_eval_exec", "CWE-94", "Code Injection", "CRITICAL", "Text that is not fixed is compiled."), lambda e: _call(e) & (e["name"] == "compile") & e["bare"] & e["dynamic"]),
            (_v("check_eval_exec", "CWE-94", "Code Injection", "HIGH", "The module's name is a value."), lambda e: _call(e) & (e["name"] == "__import__")),
        ),
    ),
    ("check_insufficient_logging", ((_v("check_insufficient_logging", "CWE-778", "Insufficient Logging", "LOW", "The handler catches everything and reports nothing."), lambda e: (e["kind"] == "except") & e["flags"][0] & ~e["flags"][3]),)),
    ("check_insecure_random", ((_v("check_insecure_random", "CWE-338", "Insecure Randomness", "LOW", "These numbers can be predicted; use secrets."), lambda e: _call(e) & e["name"].startswith("random.") & _last(e).isin(*RANDOM)),)),
    ("check_format_string", ((_v("check_format_string", "CWE-134", "Externally-Controlled Format String", "MEDIUM", "The format is not fixed."), lambda e: _call(e) & (e["name"] == "str.format") & e["dynamic"]),)),
    ("check_insecure_default", ((_v("check_insecure_default", "CWE-453", "Insecure Default", "HIGH", "allow_pickle is on."), lambda e: (e["kind"] == "risky") | (_call(e) & e["at"].isNotNull())),)),
    ("check_request_timeout", ((_v("check_request_timeout", "CWE-1088", "Synchronous Access without Timeout", "HIGH", "The request can wait for ever; give it a timeout."), lambda e: _call(e) & e["name"].isin(*(f"requests.{m}" for m in HTTP)) & ~F.array_contains(e["keywords"], "timeout")),)),
    ("check_torch_load", ((_v("check_torch_load", "CWE-502", f"{_UNTRUSTED} (torch.load)", "CRITICAL", "Without weights_only=True the file's code runs."), lambda e: _call(e) & (e["name"] == "torch.load") & ~F.array_contains(e["true_keywords"], "weights_only")),)),
    (
        "check_except_pass",
        (
            (_v("check_except_pass", "CWE-391", "Unchecked Error Condition", "MEDIUM", "The error is dropped."), lambda e: (e["kind"] == "except") & e["flags"][1]),
            (_v("check_except_pass", "CWE-391", "Unchecked Error Condition", "MEDIUM", "The error is dropped and the loop goes on."), lambda e: (e["kind"] == "except") & e["flags"][2]),
        ),
    ),
    (
        "check_pandas_eval",
        (
            (_v("check_pandas_eval", "CWE-94", "Code Injection (pandas eval)", "CRITICAL", "The expression is evaluated as Python."), lambda e: _call(e) & _pandas(e)),
            (_v("check_pandas_eval", "CWE-94", "Code Injection (DataFrame eval/query)", "HIGH", "The query is evaluated as Python."), lambda e: _call(e) & e["name"].contains(".") & _last(e).isin("eval", "query")),
        ),
    ),
    ("check_numpy_load", ((_v("check_numpy_load", "CWE-502", f"{_UNTRUSTED} (numpy.load)", "HIGH", "Object arrays are unpickled."), lambda e: _call(e) & e["name"].isin("numpy.load", "np.load") & F.array_contains(e["true_keywords"], "allow_pickle")),)),
    ("check_parquet_arrow_deserialize", ((_v("check_parquet_arrow_deserialize", "CWE-502", f"{_UNTRUSTED} (Arrow Extension)", "CRITICAL", "The hook runs while a schema is read."), lambda e: (e["kind"] == "def") & e["bare"] & (e["name"] == "__arrow_ext_deserialize__")),)),
    ("check_decode_exec_chains", ((_v("check_decode_exec_chains", "CWE-94", "Code Injection (inline decode-exec)", "CRITICAL", "Decoded text is run at once."), lambda e: _call(e) & e["bare"] & e["name"].isin("exec", "eval") & e["inner"].isin(*DECODERS)),)),
    (
        "check_huggingface_unsafe_download",
        (
            (_v("check_huggingface_unsafe_download", "CWE-94", "Code Injection (HuggingFace trust_remote_code)", "CRITICAL", "The repository's own code runs."), lambda e: _hub(e) & _trusts(e)),
            (_v("check_huggingface_unsafe_download", "CWE-1104", "Supply Chain — Unpinned Model Revision", "MEDIUM", "What is loaded can change under this line; pin a revision."), lambda e: _hub(e) & (_last(e) == "from_pretrained") & ~F.array_contains(e["keywords"], "revision")),
        ),
    ),
    ("check_unbounded_pydantic_field", ((_v("check_unbounded_pydantic_field", "CWE-770", "Unbounded Request Field Size", "MEDIUM", "A request can make this field as long as it likes.", "MEDIUM"), lambda e: (e["kind"] == "field") & ~e["flags"][0]),)),
)
