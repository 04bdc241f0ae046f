"""Native column expressions (no Python UDFs)."""

from pagefold.functions.text import (  # noqa: F401
    decode_entities, normalize_text, truncate, first_line, squash_ws,
)
from pagefold.functions.url import (  # noqa: F401
    resolve_url, url_host, registrable_ish, same_site, strip_fragment,
    url_equal_ignoring_fragment,
)
from pagefold.functions.redact import (  # noqa: F401
    redact_headers, redact_userinfo, is_sensitive_header, redact_header_value,
)
