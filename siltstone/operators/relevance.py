"""Why a check's findings matter for attacks that nobody knows yet: a text for each check that has something to say."""

from __future__ import annotations

RELEVANCE: dict[str, str] = {
    "check_pickle": "New ways past pickle filters keep being found; what is not unpickled needs no filter.",
    "check_command_injection": "Unknown holes elsewhere often end in a shell call like this one.",
    "check_sql_injection": "Injection into SQL stays among the classes exploited first.",
    "check_hardcoded_secrets": "Secrets read from source code are a usual first step of supply-chain attacks.",
    "check_yaml_deserialize": "A loader like this, even in a dependency, runs what a document tells it to.",
    "check_xxe": "Parsers of data pipelines are tried with external entities again and again.",
    "check_ssrf": "Requests to chosen addresses reach cloud metadata that no firewall guards.",
    "check_redos": "One long header can stop a gateway whose patterns backtrack.",
    "check_assert_security": "A check that an option removes is a bypass waiting to be noticed.",
    "check_supply_chain": "Name confusion between indexes is how foreign packages get installed.",
    "check_ssti": "Template holes have been chained with unsafe loading to run code.",
    "check_log_secrets": "Secrets in logs are found by whoever collects the logs.",
    "check_tls_verify": "Without verification any flaw on the way becomes an interception.",
    "check_zipslip": "Archives that overwrite programs turn an upload into execution.",
    "check_hardcoded_tokens": "Public repositories are searched for such keys within minutes.",
    "check_weak_crypto": "Old ciphers and paddings are broken by attacks known for decades.",
    "check_trojan_source": "Reordered text passes a review that reads what is shown.",
    "check_ssh_host_key": "An unverified host is a link of many chains that steal credentials.",
    "check_pandas_pickle": "A frame on disk can carry code like any other pickle.",
    "check_numpy_load_lib": "A library that is loaded by path is code from that path.",
    "check_pandas_xml_xxe": "Tables read from XML bring the parser's holes into the pipeline.",
    "check_pth_startup_hooks": "Start-up files of hijacked packages run before anything can look at them.",
    "check_legacy_pycrypto": "Holes in a package without maintainers stay open.",
    "check_model_file_load": "Shared models are a usual carrier of code in attacks on machine learning.",
    "check_weak_tls_version": "Broken protocol versions let a session be read later.",
    "check_insufficient_logging": "What leaves no trace is noticed months late.",
    "check_insecure_default": "A flag that allows pickles is an entry point that scanners miss.",
    "check_request_timeout": "Connections that hang for ever use up a service without any login.",
    "check_torch_load": "Poisoned checkpoints run code when they are loaded like this.",
    "check_pandas_eval": "Expressions reach from attribute to attribute until they reach the system.",
    "check_numpy_load": "Arrays of objects have been used to run code in loaders.",
    "check_parquet_arrow_deserialize": "Metadata of data files has carried pickles into query engines.",
    "check_decode_exec_chains": "Decoding and running in one step is the mark of most hijacked packages.",
    "check_huggingface_unsafe_download": "A repository that changes, or brings its own code, is somebody else's program.",
    "check_unbounded_pydantic_field": "Fields without limits let one request take all memory.",
    "check_dependency_cve": "Most break-ins by unknown holes come through third-party code.",
    "check_unbounded_pins": "A later release that was hijacked is installed without a question.",
}
