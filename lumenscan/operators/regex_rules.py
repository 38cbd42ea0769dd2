"""Line scanner: thirty patterns for secrets and traces of infrastructure."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import at_most

MAX_LINE = 2000


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    pattern: str
    message: str
    needs: tuple[str, ...] = ()  # texts, in lower case, that every match holds
    one_of: tuple[str, ...] = ()  # texts, in lower case, of which every match holds one

    def candidate(self, lower: Column) -> Column:
        """Whether a line, in lower case, can match: told before the slower pattern."""
        out = F.lit(True)
        if self.one_of:
            out = reduce(lambda a, b: a | b, (lower.contains(x) for x in self.one_of))
        return reduce(lambda a, b: a & b, (lower.contains(x) for x in self.needs), out)

    def matches(self, line: Column, lower: Column) -> Column:
        return F.when(self.candidate(lower), line.rlike(self.pattern)).otherwise(False)


# Rule ids, levels and patterns, in their order.
_RULES = (
    Rule("SEC_AWS_KEY", "error", r"AKIA[0-9A-Z]{16}", "AWS access key id"),
    Rule("SEC_GITHUB_PAT", "error", r"ghp_[a-zA-Z0-9]{36}", "GitHub personal access token"),
    Rule("SEC_STRIPE_KEY", "error", r"sk_live_[0-9a-zA-Z]{24}", "Stripe live secret key"),
    Rule("SEC_SLACK_WEBHOOK", "error", r"https://hooks\.slack\.com/services/T[A-Z0-9]{8}/B[A-Z0-9]{8}/[a-zA-Z0-9]{24}", "Slack webhook address"),
    Rule("SEC_GCP_API_KEY", "error", r"AIza[0-9A-Za-z\-_]{35}", "Google Cloud API key"),
    Rule("SEC_RSA_PRIVATE_KEY", "error", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", "Private key in source text"),
    Rule("SEC_HIGH_ENTROPY_VAR", "warning", r"""(?i)(?:key|secret|token|password|auth|api_key)\s*[:=]\s*['"`][A-Za-z0-9+/=_-]{32,}['"`]""", "Long string under a secret's name"),
    Rule("SEC_HARDCODED_PASSWORD", "error", r"""(?i)password\s*[:=]\s*['"`](?!\s*['"`]|null|undefined).+['"`]""", "Password in source text"),
    Rule("SEC_FIREBASE_CONFIG_LEAK", "error", r"(?i)(?=.*apiKey)(?=.*authDomain)(?=.*databaseURL).*", "Firebase configuration on one line"),
    Rule("SEC_DB_CONNECTION_STRING", "error", r"(?i)(mongodb(?:\+srv)?|postgres|mysql)://[^:\s]+:[^@\s]+@[^\s]+", "Database address with credentials"),
    Rule("SEC_SSH_KEY_TYPE", "error", r"(?:ssh-rsa|ssh-ed25519)\s+AAAA[0-9A-Za-z+/]+[=]{0,3}", "SSH key material"),
    Rule("SEC_HARDCODED_JWT_SECRET", "error", r"""jwt\.sign\s*\([^,]+,\s*(?:'[^']+'|"[^"]+"|`[^`]+`)\)""", "JWT signed with a literal secret"),
    Rule("SEC_LEAKED_DOT_ENV", "warning", r"(?m)^([A-Z_]+[A-Z0-9_]*)=[\w.-]+$", "Environment assignment in source text"),
    Rule("SEC_POSTMAN_ENV_VAR", "warning", r"(?i)\{\{[a-zA-Z0-9_]+secret[a-zA-Z0-9_]*\}\}", "Template placeholder of a secret"),
    Rule("SEC_IMPLICIT_FALLBACK_SECRET", "warning", r"""(?i)process\.env\.[A-Z0-9_]+SECRET[A-Z0-9_]*\s*\|\|\s*['"`][^'"`]+['"`]""", "Literal fallback of an environment secret"),
    Rule("INFRA_INTERNAL_IP", "note", r"""(?:^|['"\s])(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})(?:['"\s]|$)""", "Private network address"),
    Rule("INFRA_CLOUD_METADATA_SSRF", "error", r"(?i)169\.254\.169\.254|metadata\.google\.internal", "Cloud metadata address"),
    Rule("INFRA_SUBDOMAIN_BRUTE_LIST", "note", r"""(?i)\[\s*['"`](dev|uat|prod|staging|test|internal)['"`]""", "List of environment names"),
    Rule("INFRA_S3_BUCKET", "warning", r"(?i)(?:s3\.amazonaws\.com|s3://)[\w.-]+", "S3 bucket address"),
    Rule("INFRA_AZURE_BLOB", "warning", r"(?i)[\w.-]+\.blob\.core\.windows\.net", "Azure blob address"),
    Rule("INFRA_HARDCODED_HTTP", "note", r"(?i)https?://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)[\w.-]+", "External HTTP address"),
    Rule("INFRA_KUBERNETES_API", "warning", r"(?i)kubernetes\.default\.svc|/var/run/secrets/kubernetes\.io/serviceaccount", "Kubernetes service or account path"),
    Rule("INFRA_DOCKER_SOCKET", "error", r"/var/run/docker\.sock", "Docker socket path"),
    Rule("INFRA_SHADOW_API", "warning", r"(?i)/(?:v0|v1|debug|internal|admin)/(?:api|users|config)", "Debug or shadow API path"),
    Rule("INFRA_INTRANET_PORT_SCAN", "note", r"localhost:\d{4,5}|127\.0\.0\.1:\d{4,5}", "Local service port"),
    Rule("INFRA_EMAIL_EXTRACTION", "note", r"(?i)[a-zA-Z0-9._%+-]+@(?:admin|internal|corp|company)\.[a-zA-Z]{2,}", "Internal mail address"),
    Rule("INFRA_DOH_USAGE", "note", r"(?i)cloudflare-dns\.com/dns-query|dns\.google/resolve", "DNS over HTTPS service"),
    Rule("INFRA_CORS_STAR", "error", r"(?i)Access-Control-Allow-Origin:\s*\*", "CORS for every origin"),
    Rule("INFRA_GRAPHQL_INTROSPECTION", "warning", r"(?i)__schema|__type|introspectionQuery", "GraphQL introspection"),
    Rule("INFRA_INTERNAL_FILE_PATH", "warning", r"(?:/home/[a-zA-Z0-9_]+/|C:\\Users\\[a-zA-Z0-9_]+\\)", "Path of a user's folder"),
)


#: Texts that the patterns cannot do without: all of the first, one of the second.
_LITERALS = {
    "SEC_AWS_KEY": (("akia",), ()), "SEC_GITHUB_PAT": (("ghp_",), ()), "SEC_STRIPE_KEY": (("sk_live_",), ()), "SEC_SLACK_WEBHOOK": (("https://hooks.slack.com/services/t",), ()), "SEC_GCP_API_KEY": (("aiza",), ()),
    "SEC_RSA_PRIVATE_KEY": (("-----begin ",), ()), "SEC_HIGH_ENTROPY_VAR": ((), ("key", "secret", "token", "password", "auth")), "SEC_HARDCODED_PASSWORD": (("password",), ()), "SEC_FIREBASE_CONFIG_LEAK": (("apikey", "authdomain", "databaseurl"), ()),
    "SEC_DB_CONNECTION_STRING": (("://", "@"), ("mongodb", "postgres", "mysql")), "SEC_SSH_KEY_TYPE": (("ssh-", "aaaa"), ()), "SEC_HARDCODED_JWT_SECRET": (("jwt.sign",), ()), "SEC_LEAKED_DOT_ENV": (("=",), ()), "SEC_POSTMAN_ENV_VAR": (("{{", "secret"), ()),
    "SEC_IMPLICIT_FALLBACK_SECRET": (("process.env.", "||"), ()), "INFRA_INTERNAL_IP": ((), ("10.", "172.", "192.168.")), "INFRA_CLOUD_METADATA_SSRF": ((), ("169.254.169.254", "metadata.google.internal")),
    "INFRA_SUBDOMAIN_BRUTE_LIST": (("[",), ("dev", "uat", "prod", "staging", "test", "internal")), "INFRA_S3_BUCKET": ((), ("s3.amazonaws.com", "s3://")), "INFRA_AZURE_BLOB": ((".blob.core.windows.net",), ()), "INFRA_HARDCODED_HTTP": (("http", "://"), ()),
    "INFRA_KUBERNETES_API": (("kubernetes",), ()), "INFRA_DOCKER_SOCKET": (("/var/run/docker.sock",), ()), "INFRA_SHADOW_API": ((), ("/v0", "/v1", "/debug", "/internal", "/admin")), "INFRA_INTRANET_PORT_SCAN": ((), ("localhost:", "127.0.0.1:")),
    "INFRA_EMAIL_EXTRACTION": (("@",), ("admin.", "internal.", "corp.", "company.")), "INFRA_DOH_USAGE": ((), ("cloudflare-dns.com/dns-query", "dns.google/resolve")), "INFRA_CORS_STAR": (("access-control-allow-origin",), ()),
    "INFRA_GRAPHQL_INTROSPECTION": ((), ("__schema", "__type", "introspectionquery")), "INFRA_INTERNAL_FILE_PATH": ((), ("/home/", "c:\\users\\")),
}
RULES = tuple(replace(r, needs=_LITERALS[r.id][0], one_of=_LITERALS[r.id][1]) for r in _RULES)


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line: all columns of ``files`` but the content, line_no from 1, line. A trailing carriage
    return stays; null content has no line, empty content one."""
    keep = [c for c in files.columns if c != content]
    cut = files.select(*keep, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line"))
    return cut.withColumn("line_no", F.col("line_no") + 1)


def scan_lines(rows: DataFrame, rules: tuple[Rule, ...] = RULES, line: str = "line") -> DataFrame:
    """Findings of the rules: the columns of ``rows`` but the line, and rule_no, rule_id, level, message.
    Lines over MAX_LINE are passed over; a rule fires once a line.

    One search for any of the rules' literals tells the lines apart that can match at all; each rule's own literals name
    it a candidate, and patterns run on candidates only."""
    keep = [c for c in rows.columns if c != line]
    # All literals as one automaton: a trie in a pattern, each character read a few times at most.
    some = rows.filter(at_most(F.col(line), MAX_LINE) & F.col(line).rlike(any_literal(rules)))
    own = "lower_line"
    while own in rows.columns:
        own = "_" + own
    text, lower = F.col(line), F.col(own)
    hits = F.array(*[F.when(r.matches(text, lower), F.struct(F.lit(k).alias("rule_no"), F.lit(r.id).alias("rule_id"), F.lit(r.level).alias("level"), F.lit(r.message).alias("message"))) for k, r in enumerate(rules)])
    found = some.withColumn(own, F.lower(text)).withColumn("hits", F.filter(hits, lambda h: h.isNotNull()))
    return found.select(*keep, F.explode("hits").alias("hit")).select(*keep, "hit.*")


def any_literal(rules: tuple[Rule, ...]) -> str:
    """A pattern for lines that hold some rule's first literal, or one of its choice: a trie, so that a
    character is tried against the next characters only."""
    words = {w for r in rules for w in (r.needs[:1] or r.one_of)}
    words = {w for w in words if not any(v != w and v in w for v in words)}  # a shorter one finds it too

    def trie(ends: set[str]) -> str:
        if len(ends) == 1:
            return re.escape(next(iter(ends)))
        heads = sorted({w[0] for w in ends})
        return "(?:" + "|".join(re.escape(h) + trie({w[1:] for w in ends if w[0] == h}) for h in heads) + ")"

    return "(?i)" + trie(words)


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, r.id, r.level, r.message) for k, r in enumerate(RULES)], "rule_no int, rule_id string, level string, message string")
