"""What one comparison report covers."""

from __future__ import annotations

from dataclasses import dataclass, field

# Regions, countries and indicator/disaggregate pairs as they appear in the data.
DOMINICAN_REPUBLIC = "Dominican Republic"
WESTERN_HEMISPHERE = "Western Hemisphere Region"
CARIBBEAN = ("Jamaica", "Trinidad and Tobago")
CENTRAL_AMERICA = ("El Salvador", "Honduras", "Guatemala", "Brazil", "Nicaragua", "Panama")
COUNTRY_REPORT_EXCLUSIONS = (
    ("GEND_GBV", "Age/Sex/ViolenceType"),
    ("HTS_TST", "KeyPop/Result"),
    ("HTS_TST_POS", "KeyPop/Result"),
    ("PrEP_CT", "KeyPop"),
    ("PrEP_CURR", "KeyPop"),
    ("PrEP_NEW", "KeyPop"),
    ("TB_PREV", "Age/Sex/NewExistingArt/HIVStatus"),
    ("TB_PREV_D", "Age/Sex/NewExistingArt/HIVStatus"),
    ("TX_CURR", "KeyPop/HIVStatus"),
    ("TX_NEW", "KeyPop/HIVStatus"),
    ("TX_TB_D", "Age Aggregated/Sex/TBScreen/NewExistingART/HIVStatus"),
    ("PrEP_CT", "Age/Sex/HIVStatus"),
    ("TX_PVLS", "KeyPop/HIVStatus"),
    ("TX_PVLS_D", "KeyPop/HIVStatus"),
)
REGIONAL_EXCLUSIONS = (("PrEP_CT", "Age/Sex/HIVStatus"),)
TB_STATUS = ("TB_STAT", "TB_STAT_D")


@dataclass(frozen=True)
class Supplement:
    """Result rows that enter a report although the disaggregate mapping does not list them."""

    indicator: str
    standardizeddisaggregate: str
    first_year: int


CAREGIVERS = Supplement("OVC_SERV", "Age/Sex/ProgramStatusCaregiver", 2022)


@dataclass(frozen=True)
class Profile:
    """Settings of a comparison.

    ``years`` become columns; ``before`` and ``after`` are compared, the last two if not given.
    ``unlisted`` says what to do with rows of other years from the first on: stop with ``"error"``,
    ``"drop"`` them or give each year a ``"column"``. ``duplicates`` says what to do with two
    disaggregates of one indicator, population and year: ``"sum"`` them or stop with ``"error"``.
    ``change`` is ``"fraction"`` (rounded to 2 digits) or ``"percent"`` (whole percent as text).
    ``formatted`` tables have numbers as text with separators, if not given those with a fraction.
    ``shared_year`` says what to do with results that already hold the plan year: ``"keep"`` them
    beside the plan or stop with ``"error"``.
    """

    title: str
    operatingunit: str
    countries: tuple[str, ...] = ()
    by_country: bool = False
    measures: tuple[str, ...] = ("targets",)
    years: tuple[int, ...] = (2023, 2024)
    plan_year: int = 2024
    exclusions: tuple[tuple[str, str], ...] = REGIONAL_EXCLUSIONS
    excluded_indicators: tuple[str, ...] = ()
    before: int | None = None
    after: int | None = None
    unlisted: str = "error"
    duplicates: str = "error"
    change: str = "percent"
    formatted: bool | None = None
    drop_zero_and_absent: bool = True
    shared_year: str = "keep"
    supplement: Supplement | None = None
    labels: dict[str, str] = field(default_factory=dict, hash=False)
    key_labels: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.duplicates not in ("error", "sum"):
            raise ValueError(f"unknown duplicates rule: {self.duplicates}")
        if self.change not in ("fraction", "percent"):
            raise ValueError(f"unknown change form: {self.change}")
        if self.shared_year not in ("keep", "error"):
            raise ValueError(f"unknown shared year rule: {self.shared_year}")
        if len(self.years) < 2 or list(self.years) != sorted(set(self.years)):
            raise ValueError("years must be two or more, ascending")
        if self.unlisted not in ("error", "drop", "column"):
            raise ValueError(f"unknown rule for unlisted years: {self.unlisted}")
        if not {self.before, self.after} <= {None, *self.years}:
            raise ValueError("the compared years must be among the years")
        if self.by_country and len(self.measures) > 1:
            raise ValueError("a report by country has one measure")

    @property
    def first_year(self) -> int:
        return self.years[0]

    @property
    def compared(self) -> tuple[int, int]:
        """The earlier and the later year of the comparison."""
        before, after = self.years[-2:]
        return self.before or before, self.after or after

    @property
    def places(self) -> tuple[str, ...]:
        return ("country",) if self.by_country else ()

    @property
    def ids(self) -> tuple[str, ...]:
        return (*self.places, "indicator", "all_or_KP")


# Report titles and column headings.
_COUNTRY_LABELS = {
    "targets_diff_fy_24_23": "targets change_FY24_23",
    "targets_percent_change_24_23": "targets % change FY24_FY23",
    "cumulative_FY22": "results_FY22",
    "cumulative_FY23": "results_FY23",
}
_COUNTRY_KEY_LABELS = {
    **_COUNTRY_LABELS,
    "targets_percent_change_24_23": "targets % change FY24-FY23",
}
_REGIONAL_LABELS = {"diff": "change", "percent_change": "% change"}


def regional(title: str, countries: tuple[str, ...], **settings) -> Profile:
    """A targets-only report over some countries of the region."""
    return Profile(
        title=title,
        operatingunit=WESTERN_HEMISPHERE,
        countries=countries,
        labels=_REGIONAL_LABELS,
        key_labels=_REGIONAL_LABELS,
        **settings,
    )


_CENTRAL_AMERICA_RULES = {"excluded_indicators": TB_STATUS, "drop_zero_and_absent": False}

PROFILES = {
    "dominican_republic": Profile(
        title="Dominican Republic Target Summary",
        operatingunit=DOMINICAN_REPUBLIC,
        measures=("targets", "cumulative"),
        years=(2022, 2023, 2024),
        exclusions=COUNTRY_REPORT_EXCLUSIONS,
        unlisted="drop",
        duplicates="sum",
        change="fraction",
        supplement=CAREGIVERS,
        labels=_COUNTRY_LABELS,
        key_labels=_COUNTRY_KEY_LABELS,
    ),
    "caribbean": regional("Caribbean Target Summary", CARIBBEAN),
    "caribbean_by_country": regional("Caribbean Target Summary", CARIBBEAN, by_country=True),
    "central_america": regional(
        "Central America Target Summary", CENTRAL_AMERICA, **_CENTRAL_AMERICA_RULES
    ),
    "central_america_by_country": regional(
        "Central America Target Summary", CENTRAL_AMERICA, by_country=True, **_CENTRAL_AMERICA_RULES
    ),
}
