"""The shipped patterns."""

from __future__ import annotations

from siftline.operators.patterns import Pattern, pattern

# Names, flags, tags and regular expressions of the shipped patterns.
LIBRARY: list[Pattern] = [
    pattern("all_lines", r".+"),
    pattern("any", r".*"),
    pattern(
        "aws-keys",
        r"([^A-Z0-9]|^)(AKIA|A3T|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{12,}",
        flags="-HanrE",
        tags=["cloud", "secrets"],
        needs=["AKIA", "A3T", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA"],
    ),
    pattern(
        "base64",
        r"([^A-Za-z0-9+/]|^)(eyJ|YTo|Tzo|PD[89]|aHR0cHM6L|aHR0cDo|rO0)[%a-zA-Z0-9+/]+={0,2}",
        flags="-HnroE",
        tags=["encoding"],
        needs=["eyJ", "YTo", "Tzo", "PD", "aHR0c", "rO0"],
    ),
    pattern("cors", ["Access-Control-Allow"], flags="-HnriE"),
    pattern(
        "debug-pages",
        r"""(Application-Trace|Routing Error|DEBUG"? ?[=:] ?True|Caused by:|stack trace:|Microsoft .NET Framework|Traceback|[0-9]:in `|#!/us|WebApplicationException|java\.lang\.|phpinfo|swaggerUi|on line [0-9]|SQLSTATE)""",
        flags="-HnraiE",
        needs=[
            "application-trace", "routing error", "debug", "caused by:", "stack trace:", "microsoft ", "traceback",
            ":in `", "#!/us", "webapplicationexception", "java.lang.", "phpinfo", "swaggerui", "on line ", "sqlstate",
        ],
    ),
    pattern("firebase", r"firebaseio.com", flags="-Hnri", tags=["cloud", "database"]),
    pattern(
        "fw",
        [
            "django", "laravel", "symfony", "graphite", "grafana", "X-Drupal-Cache", "struts",
            "code ?igniter", "cake ?php", "grails", "elastic ?search", "kibana", "log ?stash",
            "tomcat", "jenkins", "hudson", "com.atlassian.jira", "Apache Subversion", "Chef Server",
            "RabbitMQ Management", "Mongo", "Travis CI - Enterprise", "BMC Remedy", "artifactory",
        ],
        flags="-HnriE",
    ),
    pattern("go-functions", r"func [a-z0-9_]+\(", flags="-HnriE"),
    pattern("http-auth", r"[a-z0-9_/\.:-]+@[a-z0-9-]+\.[a-z0-9.-]+", flags="-hrioaE", needs=["@"]),
    pattern(
        "ip",
        r"(([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])",
        flags="-HnroE",
        sieve=r"\.[0-9]{1,3}\.[0-9]",
    ),
    pattern(
        "json-sec",
        r"""(\\?"|&quot;|%22)[a-z0-9_-]*(api[_-]?key|S3|aws_|secret|passw|auth)[a-z0-9_-]*(\\?"|&quot;|%22): ?(\\?"|&quot;|%22)[^"&]+(\\?"|&quot;|%22)""",
        flags="-harioE",
        needs=['":', "&quot;:", "%22:"],
    ),
    pattern("meg-headers", r"^< [a-z0-9_\-]+: .*", flags="-hroiE", needs=["< "]),
    pattern(
        "php-curl",
        r"CURLOPT_(HTTPHEADER|HEADER|COOKIE|RANGE|REFERER|USERAGENT|PROXYHEADER)",
        flags="-HnrE",
        needs=["CURLOPT_"],
    ),
    pattern(
        "php-errors",
        [
            "php warning", "php error", "fatal error", "uncaught exception", "include_path",
            "undefined index", "undefined variable", r"\?php", r"<\?[^x]", r"stack trace\:",
            "expects parameter [0-9]*", "Debug Trace",
        ],
        flags="-HnriE",
        tags=["debug", "error"],
        needs=[
            "php", "fatal error", "uncaught exception", "include_path", "undefined ", "<?", "stack trace:",
            "expects parameter ", "debug trace",
        ],
    ),
    pattern("php-serialized", ["a:[0-9]+:{", 'O:[0-9]+:"', 's:[0-9]+:"'], flags="-HnrE", needs=["a:", "O:", "s:"]),
    pattern(
        "php-sinks",
        r"[^a-z0-9_](system|exec|popen|pcntl_exec|eval|create_function|unserialize|file_exists|md5_file|filemtime|filesize|assert) ?\(",
        flags="-HnriE",
        needs=["("],
    ),
    pattern(
        "php-sources",
        [r"\$_(POST|GET|COOKIE|REQUEST|SERVER|FILES)", "php://(input|stdin)"],
        flags="-HnrE",
        needs=["$_", "php://"],
    ),
    pattern(
        "s3-buckets",
        [
            r"[a-z0-9.-]+\.s3\.amazonaws\.com",
            r"[a-z0-9.-]+\.s3-[a-z0-9-]\.amazonaws\.com",
            r"[a-z0-9.-]+\.s3-website[.-](eu|ap|us|ca|sa|cn)",
            r"//s3\.amazonaws\.com/[a-z0-9._-]+",
            r"//s3-[a-z0-9-]+\.amazonaws\.com/[a-z0-9._-]+",
        ],
        flags="-hrioaE",
        tags=["cloud", "storage"],
        needs=[".amazonaws.com", ".s3-website", "//s3"],
    ),
    pattern(
        "sec",
        r"(aws_access|aws_secret|api[_-]?key|ListBucketResult|S3_ACCESS_KEY|Authorization:|RSA PRIVATE|Index of|aws_|secret|ssh-rsa AA)",
        flags="-HanriE",
        needs=[
            "aws_", "api", "listbucketresult", "s3_access_key", "authorization:", "rsa private", "index of", "secret",
            "ssh-rsa aa",
        ],
    ),
    pattern("servers", r"server: ", flags="-hri"),
    pattern("strings", [r'"[^"]+"', r"'[^']+'"], flags="-hroiaE", needs=['"', "'"]),
    pattern(
        "takeovers",
        [
            "There is no app configured at that hostname",
            "NoSuchBucket",
            "No Such Account",
            "You're Almost There",
            "a GitHub Pages site here",
            "There's nothing here",
            "project not found",
            "Your CNAME settings",
            "InvalidBucketName",
            "PermanentRedirect",
            "The specified bucket does not exist",
            "Repository not found",
            "Sorry, We Couldn't Find That Page",
            "The feed has not been found.",
            "The thing you were looking for is no longer here, or never was",
            "Please renew your subscription",
            "There isn't a Github Pages site here.",
            "We could not find what you're looking for.",
            "No settings were found for this company:",
            "No such app",
            "is not a registered InCloud YouTrack",
            "Unrecognized domain",
            "project not found",
            "This UserVoice subdomain is currently available!",
            "Do you want to register",
            "Help Center Closed",
        ],
        flags="-HnriE",
        tags=["cve", "subdomain"],
    ),
    pattern("upload-fields", r"""<input[^>]+type=["']?file["']?""", flags="-HnriE", needs=["<input"]),
    pattern("urls", r"""https?://[^"\'> ]+""", flags="-oriahE", tags=["recon"], needs=["://"]),
]
