"""Login agents (browser, platform, robot, device) and session data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Agent marks in order of precedence, first match wins.
PLATFORMS = {
    "windows nt 10.0": "Windows 10", "windows nt 6.3": "Windows 8.1", "windows nt 6.2": "Windows 8",
    "windows nt 6.1": "Windows 7", "windows nt 6.0": "Windows Vista", "windows nt 5.2": "Windows 2003",
    "windows nt 5.1": "Windows XP", "windows nt 5.0": "Windows 2000", "windows nt 4.0": "Windows NT 4.0",
    "winnt4.0": "Windows NT 4.0", "winnt 4.0": "Windows NT", "winnt": "Windows NT",
    "windows 98": "Windows 98", "win98": "Windows 98", "windows 95": "Windows 95", "win95": "Windows 95",
    "windows phone": "Windows Phone", "windows": "Unknown Windows OS", "android": "Android",
    "blackberry": "BlackBerry", "iphone": "iOS", "ipad": "iOS", "ipod": "iOS", "os x": "Mac OS X",
    "ppc mac": "Power PC Mac", "freebsd": "FreeBSD", "ppc": "Macintosh", "linux": "Linux",
    "debian": "Debian", "sunos": "Sun Solaris", "beos": "BeOS", "apachebench": "ApacheBench",
    "aix": "AIX", "irix": "Irix", "osf": "DEC OSF", "hp-ux": "HP-UX", "netbsd": "NetBSD",
    "bsdi": "BSDi", "openbsd": "OpenBSD", "gnu": "GNU/Linux", "unix": "Unknown Unix OS",
    "symbian": "Symbian OS",
}
BROWSERS = {  # regular expressions
    "OPR": "Opera", "Flock": "Flock", "Edge": "Edge", "Chrome": "Chrome", "Opera.*?Version": "Opera",
    "Opera": "Opera", "MSIE": "Internet Explorer", "Internet Explorer": "Internet Explorer",
    "Trident.* rv": "Internet Explorer", "Shiira": "Shiira", "Firefox": "Firefox",
    "Chimera": "Chimera", "Phoenix": "Phoenix", "Firebird": "Firebird", "Camino": "Camino",
    "Netscape": "Netscape", "OmniWeb": "OmniWeb", "Safari": "Safari", "Mozilla": "Mozilla",
    "Konqueror": "Konqueror", "icab": "iCab", "Lynx": "Lynx", "Links": "Links", "hotjava": "HotJava",
    "amaya": "Amaya", "IBrowse": "IBrowse", "Maxthon": "Maxthon", "Ubuntu": "Ubuntu Web Browser",
}
ROBOTS = {
    "googlebot": "Googlebot", "msnbot": "MSNBot", "baiduspider": "Baiduspider", "bingbot": "Bing",
    "slurp": "Inktomi Slurp", "yahoo": "Yahoo", "ask jeeves": "Ask Jeeves",
    "fastcrawler": "FastCrawler", "infoseek": "InfoSeek Robot 1.0", "lycos": "Lycos",
    "yandex": "YandexBot", "mediapartners-google": "MediaPartners Google",
    "CRAZYWEBCRAWLER": "Crazy Webcrawler", "adsbot-google": "AdsBot Google",
    "feedfetcher-google": "Feedfetcher Google", "curious george": "Curious George",
    "ia_archiver": "Alexa Crawler", "MJ12bot": "Majestic-12", "Uptimebot": "Uptimebot",
}
MOBILES = {
    "mobileexplorer": "Mobile Explorer", "palmsource": "Palm", "palmscape": "Palmscape",
    "motorola": "Motorola", "nokia": "Nokia", "nexus": "Nexus", "palm": "Palm",
    "iphone": "Apple iPhone", "ipad": "iPad", "ipod": "Apple iPod Touch", "sony": "Sony Ericsson",
    "ericsson": "Sony Ericsson", "blackberry": "BlackBerry", "cocoon": "O2 Cocoon", "blazer": "Treo",
    "lg": "LG", "amoi": "Amoi", "xda": "XDA", "mda": "MDA", "vario": "Vario", "htc": "HTC",
    "samsung": "Samsung", "sharp": "Sharp", "sie-": "Siemens", "alcatel": "Alcatel", "benq": "BenQ",
    "ipaq": "HP iPaq", "mot-": "Motorola", "playstation portable": "PlayStation Portable",
    "playstation 3": "PlayStation 3", "playstation vita": "PlayStation Vita",
    "hiptop": "Danger Hiptop", "nec-": "NEC", "panasonic": "Panasonic", "philips": "Philips",
    "sagem": "Sagem", "sanyo": "Sanyo", "spv": "SPV", "zte": "ZTE", "sendo": "Sendo",
    "nintendo dsi": "Nintendo DSi", "nintendo ds": "Nintendo DS", "nintendo 3ds": "Nintendo 3DS",
    "wii": "Nintendo Wii", "open web": "Open Web", "openweb": "OpenWeb", "android": "Android",
    "symbian": "Symbian", "SymbianOS": "SymbianOS", "elaine": "Palm", "series60": "Symbian S60",
    "windows ce": "Windows CE", "obigo": "Obigo", "netfront": "Netfront Browser",
    "openwave": "Openwave Browser", "mobilexplorer": "Mobile Explorer", "operamini": "Opera Mini",
    "opera mini": "Opera Mini", "opera mobi": "Opera Mobile", "fennec": "Firefox Mobile",
    "digital paths": "Digital Paths", "avantgo": "AvantGo", "xiino": "Xiino",
    "novarra": "Novarra Transcoder", "vodafone": "Vodafone", "docomo": "NTT DoCoMo", "o2": "O2",
    "mobile": "Generic Mobile", "wireless": "Generic Mobile", "j2me": "Generic Mobile",
    "midp": "Generic Mobile", "cldc": "Generic Mobile", "up.link": "Generic Mobile",
    "up.browser": "Generic Mobile", "smartphone": "Generic Mobile", "cellphone": "Generic Mobile",
}
UNKNOWN_PLATFORM = "Unknown Platform"
UNKNOWN_AGENT = "Unidentified User Agent"


def _first_mark(agent: Column, marks: dict[str, str]) -> Column:
    """Name of the first mark contained in the agent text, NULL if none is."""
    lower = F.lower(agent)
    chain = F
    for mark, name in marks.items():
        chain = chain.when(lower.contains(mark.lower()), F.lit(name))
    return chain.otherwise(F.lit(None))


def _browser(agent: Column) -> Column:
    """Name and version of the first browser expression that is followed by a version, in one chain."""
    found = F
    for expression, label in BROWSERS.items():
        pattern = f"(?i){expression}.*?([0-9.]+)"
        pair = F.struct(F.lit(label).alias("name"), F.regexp_extract(agent, pattern, 1).alias("version"))
        found = found.when(agent.rlike(pattern), pair)
    return found.otherwise(F.lit(None))


def classify_agents(logins: DataFrame, column: str = "agentString") -> DataFrame:
    """Platform, robot, browser, version, mobile and the label shown in the login history.

    A robot is never also a browser; a mobile name is looked up for every agent.
    """
    agent = F.col(column)
    robot = _first_mark(agent, ROBOTS)
    out = logins.withColumns({
        "platform_name": F.coalesce(_first_mark(agent, PLATFORMS), F.lit(UNKNOWN_PLATFORM)),
        "robot": robot,
        "mobile": _first_mark(agent, MOBILES),
    })
    out = out.withColumn("_b", F.when(F.col("robot").isNull(), _browser(agent)))
    out = out.withColumns({"browser": F.col("_b.name"), "version": F.col("_b.version")}).drop("_b")
    label = F.coalesce(
        F.concat_ws(" ", F.col("browser"), F.col("version")), F.lit("")
    )
    return out.withColumns({
        "is_mobile": F.col("mobile").isNotNull().cast("int"),
        "agent_label": F.when(F.col("browser").isNotNull(), label)
        .otherwise(F.coalesce("robot", "mobile", F.lit(UNKNOWN_AGENT))),
    })


def agent_breakdown(logins: DataFrame, by: tuple[str, ...] = ("platform_name", "browser")) -> DataFrame:
    """Logins per platform and browser (or other classes).

    Rows are counted per distinct agent text first, so the long list of expressions runs once per
    text and not once per login.
    """
    texts = logins.groupBy("agentString").agg(F.count(F.lit(1)).alias("n"))
    return classify_agents(texts).groupBy(*by).agg(F.sum("n").alias("logins"))


SESSION_SCHEMA = "role string, roleText string, name string"


def expand_sessions(logins: DataFrame, schema: str = SESSION_SCHEMA) -> DataFrame:
    """Session data (JSON text) as columns; unreadable text gives NULLs."""
    return logins.withColumn("_s", F.from_json("sessionData", schema)).select(
        *[c for c in logins.columns if c != "sessionData"], "_s.*"
    )


def logins_per_role_day(logins: DataFrame) -> DataFrame:
    sessions = expand_sessions(logins).withColumn("day", F.to_date("createdDtm"))
    return sessions.groupBy("role", "day").agg(F.count(F.lit(1)).alias("logins"))


def last_login(logins: DataFrame, user: int | None = None) -> DataFrame:
    """The login with the highest id of every user, or of one."""
    rows = logins if user is None else logins.where(F.col("userId") == user)
    # two buffers of fixed width, so rows are not sorted
    return rows.groupBy("userId").agg(F.max("id").alias("id"), F.max_by("createdDtm", "id").alias("createdDtm"))
