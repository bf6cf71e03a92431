"""Domain labels from host rules, content signals and the share of Latin letters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """Hosts of a domain: exact or dotted suffixes, then substrings."""

    domain: str
    suffixes: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()


def parse_rules(config: dict) -> list[Rule]:
    """Rules in the order of a parsed ``rules`` mapping; the order is the priority."""
    return [Rule(d, tuple(r.get("host_suffix", ())), tuple(r.get("host_contains", ()))) for d, r in config["rules"].items()]


def load_rules(path: str) -> list[Rule]:
    """Rules of a YAML (or JSON) file; where no YAML reader is installed, JSON alone."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return parse_rules(json.loads(text))
    return parse_rules(yaml.safe_load(text))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(priority, domain, kind, pattern): the rules as rows, in their order."""
    rows = [(k, r.domain, kind, p) for k, r in enumerate(rules) for kind, own in (("suffix", r.suffixes), ("contains", r.contains)) for p in own]
    return spark.createDataFrame(rows, "priority int, domain string, kind string, pattern string")


# Host rules in order of priority.
RULES = [
    Rule("encyclopedia", ("wikipedia.org", "namu.wiki", "wikimedia.org", "wiktionary.org", "terms.naver.com", "britannica.com")),
    Rule("blog", ("blog.naver.com", "blog.daum.net", "tistory.com", "brunch.co.kr", "velog.io", "medium.com", "egloos.com", "postype.com"), ("blog.",)),
    Rule(
        "community",
        tuple("dcinside.com fmkorea.com clien.net ruliweb.com ppomppu.co.kr bobaedream.co.kr inven.co.kr reddit.com 82cook.com mlbpark.donga.com theqoo.net instiz.net todayhumor.co.kr humoruniv.com slrclub.com cook.co.kr pann.nate.com arca.live gasengi.com etoland.co.kr".split()),
        ("cafe.", "forum", "board", "gall", "community"),
    ),
    Rule(
        "technical",
        tuple("stackoverflow.com stackexchange.com readthedocs.io docs.python.org debian.org php.net mozilla.org kernel.org ubuntu.com apache.org w3.org".split()),
        ("docs.", "developer.", "developers.", "support.", "manual", "wiki.", "help."),
    ),
    Rule(
        "news",
        tuple(
            "yna.co.kr chosun.com hani.co.kr khan.co.kr mk.co.kr hankyung.com sbs.co.kr kbs.co.kr mbc.co.kr donga.com joongang.co.kr ohmynews.com newsis.com newswire.co.kr yonhapnews.co.kr etnews.com zdnet.co.kr voakorea.com asiae.co.kr etoday.co.kr seoul.co.kr koreadaily.com mt.co.kr heraldk.com redian.org ajunews.com newstomato.com zum.com joins.com hankookilbo.com segye.com kukinews.com nocutnews.co.kr pressian.com mediatoday.co.kr ytn.co.kr gkyu.co.kr kyongbuk.co.kr maniareport.com jemin.com kookje.co.kr issuemaker.kr newsgn.com globalnewsagency.kr news1.kr kmctimes.com bestdaily.co.kr hkn24.com kns.tv safetoday.kr jjan.kr insight.co.kr bizhankook.com".split()
        ),
        ("news", "press.", "ilbo", "sinmun", "shinmun", "journal", "times."),
    ),
    Rule("code", ("github.com", "gitlab.com", "bitbucket.org", "github.io", "sourceforge.net", "npmjs.com", "pypi.org")),
]
FALLBACK = "web_general"
MIXED, MIXED_MIN = "ko_en_mixed", 0.35

# Patterns of the content signals.
SIGNALS = {
    "board": r"작성일|글쓴이|작성자|조회\s*[:：]|조회수|댓글\s*\d|추천\s*\d|등록일|스크랩|신고하기|답변\s*\d|게시글|말머리",
    "colloquial": r"[ㅋㅎㅠㅜ]{2,}|\^\^|해요[.!?]|했어요|하네요|거든요|인데요|드려요|싶어요|같아요|주세요[.!?]|나요\?|까요\?|답니다",
    "procedure": r"하십시오|하시기 바랍니다|참조하|참고하십시오|다음과 같이|다음 단계|클릭하|설정하|설치하|실행하|입력하|선택하십시오|지원하지 않는|기술 자료|사용 설명서|매뉴얼|문제 해결|오류가 발생|버전을",
    "news": r"(?U)밝혔다|전했다|말했다|덧붙였다|설명했다|강조했다|지적했다|알려졌다|기자\b|연합뉴스|뉴시스|보도자료|취재|인터뷰에서",
    "first_person": r"제가|저는|저희|내가|필자|오늘은|리뷰하려고|다녀왔",
    "spec": r"모형\s*[:：]|모델명|규격\s*[:：]|사양\s*[:：]|ISO\s*\d{4}|[A-Z]{2,}[-\s]?\d{3,}|저널명|논문제목|저자\s*[:：]|발행일\s*[:：]|편의 시설|가격대\s*\(|체크인|객실",
}


@dataclass(frozen=True)
class ContentConfig:
    """Least counts of the signals. Fixed values."""

    board: int = 1
    procedure: int = 1
    news: int = 1
    colloquial: int = 2
    first_person: int = 2
    spec: int = 1
    window: int = 180


def classify_host(host: Column, rules: list[Rule] = RULES) -> Column:
    """The first rule's domain whose suffixes or substrings fit; null if none does."""
    case = None
    for r in rules:
        tests = [(host == s) | host.endswith("." + s) for s in r.suffixes] + [host.contains(s) for s in r.contains]
        fits = tests[0]
        for t in tests[1:]:
            fits = fits | t
        case = F.when(fits, F.lit(r.domain)) if case is None else case.when(fits, F.lit(r.domain))
    return case


def signals(text: Column) -> dict[str, Column]:
    return {n: F.regexp_count(text, F.lit(p)) for n, p in SIGNALS.items()}


def classify_content(text: Column, config: ContentConfig | None = None) -> Column:
    """A domain from the beginning of the text, or null."""
    c = config or ContentConfig()
    s = signals(F.substring(text, 1, c.window))
    return (
        F.when(s["board"] >= c.board, F.lit("community"))
        .when(s["news"] >= c.news, F.lit("news"))
        .when(s["procedure"] >= c.procedure, F.lit("technical"))
        .when(s["spec"] >= c.spec, F.lit(MIXED))
        .when(s["colloquial"] >= c.colloquial, F.lit("blog"))
        .when((s["first_person"] >= c.first_person) & (s["colloquial"] >= 1), F.lit("blog"))
    )


@dataclass(frozen=True)
class Rules:
    hosts: list[Rule] = field(default_factory=lambda: RULES)
    use_content: bool = False
    mixed_min: float = MIXED_MIN
    fallback: str = FALLBACK


def classify(docs: DataFrame, rules: Rules | None = None, url: str = "url", text: str = "text") -> DataFrame:
    """``docs`` with host and domain: host rule, content rule, Latin share, fallback."""
    r = rules or Rules()
    rows = docs.withColumn("host", T.host_of(F.col(url)))
    choices = [classify_host(F.col("host"), r.hosts)]
    if r.use_content:
        choices.append(classify_content(F.col(text)))
    choices += [F.when(T.latin_share(F.col(text)) >= r.mixed_min, F.lit(MIXED)), F.lit(r.fallback)]
    return rows.withColumn("domain", F.coalesce(*choices))


def confusion(audit: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of each pair of gold and predicted label."""
    return audit.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def precision_recall(audit: DataFrame, gold: str, predicted: str) -> DataFrame:
    """By label: support, predictions, hits, precision and recall (null without a denominator)."""
    rows = audit.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col(gold) == F.col(predicted)).alias("hit"))
    out = rows.groupBy("x.label").agg(F.sum("x.g").alias("n_gold"), F.sum("x.p").alias("n_predicted"), F.sum(F.when(F.col("hit"), F.col("x.g")).otherwise(0)).alias("n_hit"))
    return out.withColumn("precision", F.try_divide("n_hit", "n_predicted")).withColumn("recall", F.try_divide("n_hit", "n_gold"))


def host_survey(pages: DataFrame, host: str = "host") -> DataFrame:
    """Each host's count and share."""
    return pages.groupBy(host).agg(F.count("*").alias("n")).crossJoin(F.broadcast(pages.agg(F.count("*").alias("__all")))).withColumn("share", F.col("n") / F.col("__all")).drop("__all")
