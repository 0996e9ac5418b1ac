"""All checks in their order, and every variant with a number."""

from __future__ import annotations

from siltstone.operators import manifest_rules as M
from siltstone.operators.ast_rules import AST_CHECKS
from siltstone.operators.rules import Variant
from siltstone.operators.text_rules import CHAIN, PTH_FILE, TEXT_CHECKS

# The order in which a file's findings are listed.
ORDER = (
    "check_pickle",
    "check_eval_exec",
    "check_command_injection",
    "check_sql_injection",
    "check_path_traversal",
    "check_hardcoded_secrets",
    "check_yaml_deserialize",
    "check_xxe",
    "check_ssrf",
    "check_tempfile",
    "check_symlink",
    "check_redos",
    "check_assert_security",
    "check_exec_driver_sql",
    "check_supply_chain",
    "check_debug_mode",
    "check_insufficient_logging",
    "check_timing_attack",
    "check_sensitive_exposure",
    "check_null_byte",
    "check_resource_limits",
    "check_insecure_random",
    "check_ssti",
    "check_crlf",
    "check_ldap",
    "check_weak_hash",
    "check_open_redirect",
    "check_log_injection",
    "check_format_string",
    "check_arbitrary_write",
    "check_insecure_default",
    "check_log_secrets",
    "check_tls_verify",
    "check_zipslip",
    "check_hardcoded_tokens",
    "check_weak_crypto",
    "check_dependency_cve",
    "check_trojan_source",
    "check_request_timeout",
    "check_torch_load",
    "check_ssh_host_key",
    "check_except_pass",
    "check_pandas_eval",
    "check_numpy_load",
    "check_pandas_pickle",
    "check_numpy_load_lib",
    "check_pandas_xml_xxe",
    "check_pth_startup_hooks",
    "check_parquet_arrow_deserialize",
    "check_unbounded_pins",
    "check_model_file_load",
    "check_decode_exec_chains",
    "check_bind_all_interfaces",
    "check_weak_tls_version",
    "check_legacy_pycrypto",
    "check_huggingface_unsafe_download",
    "check_unbounded_pydantic_field",
)

VARIANTS: tuple[Variant, ...] = (
    *(v for c in TEXT_CHECKS for g in c.groups for v in g),
    *(v for _, vs in AST_CHECKS for v, _ in vs),
    PTH_FILE,
    CHAIN,
    M.CVE,
    M.PIN,
    M.PIN_LOCKED,
)
NUMBER: dict[int, int] = {id(v): k for k, v in enumerate(VARIANTS)}


def number(v: Variant) -> int:
    return NUMBER[id(v)]
