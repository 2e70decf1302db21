"""Import profiles, their detection, and the mapping of headers to fields."""

from __future__ import annotations

from dataclasses import dataclass

# The profiles. Lines: id | domain | amount style or unit | required headers | optional headers | field: headers.
PROFILES_TEXT = """
Mn-17col-Signed | BANK | SIGNED | Гүйлгээний огноо, Гүйлгээний дүн, Гүйлгээний утга, Регистрийн дугаар | Харьцсан регистрийн дугаар, Журнал, Гүйлгээний дугаар | date: Гүйлгээний огноо; amount: Гүйлгээний дүн; time: Цаг, Гүйлгээний цаг, Хугацаа, Time; description: Гүйлгээний утга; counterpartyAccount: Харьцсан данс; counterpartyName: Харьцсан харилцагчийн нэр; counterpartyNationalId: Харьцсан регистрийн дугаар, Харьцсан регистр; account: Данс, Дансны дугаар; balance: Үлдэгдэл, Дансны үлдэгдэл, Гүйлгээний дараах үлдэгдэл; balanceBefore: Гүйлгээний өмнөх үлдэгдэл, Өмнөх үлдэгдэл; nationalId: Регистрийн дугаар, Регистр; ownerName: Харилцагчийн нэр, Дансны нэр, Хэрэглэгчийн нэр, Эзэмшигчийн нэр; currency: Валют, Currency
Mn-16col-Signed | BANK | SIGNED | Гүйлгээний огноо, Гүйлгээний дүн, Цаг | | date: Гүйлгээний огноо; amount: Гүйлгээний дүн; time: Цаг, Гүйлгээний цаг, Хугацаа, Time; description: Гүйлгээний утга; counterpartyAccount: Харьцсан данс; counterpartyName: Харьцсан харилцагчийн нэр; counterpartyNationalId: Харьцсан регистрийн дугаар, Харьцсан регистр; account: Данс, Дансны дугаар; balance: Үлдэгдэл, Дансны үлдэгдэл, Гүйлгээний дараах үлдэгдэл; balanceBefore: Гүйлгээний өмнөх үлдэгдэл, Өмнөх үлдэгдэл; nationalId: Регистрийн дугаар, Регистр; ownerName: Харилцагчийн нэр, Дансны нэр, Хэрэглэгчийн нэр, Эзэмшигчийн нэр; currency: Валют, Currency
En-Operative | BANK | SIGNED | tranDate, amount, balance | | date: tranDate; amount: amount; description: description; balance: balance; counterpartyAccount: relatedAccount; account: account, accountNumber
Mn-Split-Simple | BANK | SPLIT | Гүйлгээний огноо, Орлого, Зарлага, Үлдэгдэл | | date: Гүйлгээний огноо; credit: Орлого; debit: Зарлага; balance: Үлдэгдэл; description: Гүйлгээний утга; counterpartyAccount: Харьцсан данс; counterpartyName: Харьцсан харилцагчийн нэр, Харьцсан дансны нэр; counterpartyNationalId: Харьцсан регистрийн дугаар, Харьцсан регистр; account: Данс, Дансны дугаар; balanceBefore: Гүйлгээний өмнөх үлдэгдэл, Өмнөх үлдэгдэл; nationalId: Регистрийн дугаар, Регистр; ownerName: Харилцагчийн нэр, Дансны нэр, Хэрэглэгчийн нэр; currency: Валют, Currency
Mn-Xac-Merged | BANK | SPLIT | Огноо, Орлого, Зарлага, Гүйлгээний утга | | date: Огноо; credit: Орлого; debit: Зарлага; balance: Үлдэгдэл; description: Гүйлгээний утга; counterpartyAccount: Харьцсан данс; counterpartyName: Харьцсан дансны нэр; account: Данс, Дансны дугаар
Mn-Generic-Signed | BANK | SIGNED | Гүйлгээний огноо, Гүйлгээний дүн | Гүйлгээний утга, Үлдэгдэл, Гүйлгээний өмнөх үлдэгдэл | date: Гүйлгээний огноо, Огноо; amount: Гүйлгээний дүн, Дүн; description: Гүйлгээний утга, Утга, Тайлбар; balance: Үлдэгдэл, Дансны үлдэгдэл, Гүйлгээний дараах үлдэгдэл; balanceBefore: Гүйлгээний өмнөх үлдэгдэл, Өмнөх үлдэгдэл; counterpartyAccount: Харьцсан данс; counterpartyName: Харьцсан харилцагчийн нэр, Харьцсан дансны нэр; counterpartyNationalId: Харьцсан регистрийн дугаар, Харьцсан регистр; account: Данс, Дансны дугаар; reference: Гүйлгээний дугаар, Лавлагааны дугаар; nationalId: Регистрийн дугаар, Регистр; ownerName: Харилцагчийн нэр, Дансны нэр, Хэрэглэгчийн нэр, Эзэмшигчийн нэр; currency: Валют, Currency
Call-Bill | CDR | MINUTES | callstart, callerid, callednum | | caller: callerid, caller, calling; called: callednum, called; datetime: callstart, datetime, starttime; duration: duration_min, duration, duration minut, minut; direction: direction, call direction
Web-Access-Log | ACCESS_LOG | | Transaction Time, User, IP Address | | timestamp: Transaction Time; accountId: User; fullName: Full Name; uuid: UUID; fingerprint: fingerprint; userAgent: userAgent; ip: IP Address
Device-Log | ACCESS_LOG | | DEVICE_ID, USER_ID, ORIGINATION | | timestamp: CREATE_TS, ST_TM; accountId: USER_ID; uuid: DEVICE_ID; ip: ORIGINATION; deviceModel: MODEL, DEVICE_NAME; deviceMake: MAKE; os: OS; osVersion: OS_VERSION
"""


@dataclass(frozen=True)
class Profile:
    id: str
    domain: str
    style: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    fields: dict[str, tuple[str, ...]]


def _list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def _profile(line: str) -> Profile:
    id_, domain, style, required, optional, fields = (x.strip() for x in line.split("|"))
    return Profile(id_, domain, style, _list(required), _list(optional), {k.strip(): _list(v) for k, v in (f.split(":") for f in fields.split(";"))})


PROFILES = [_profile(line) for line in PROFILES_TEXT.strip().splitlines()]


def key(h: str | None) -> str:
    return (h or "").strip().lower()


def fit(profile: Profile, headers: set[str]) -> float:
    """Half the share of required headers while any is missing; then 0.8, with optional headers up to 1."""
    share = lambda names: sum(key(h) in headers for h in names) / len(names)
    required = share(profile.required)
    if required < 1:
        return required / 2
    return 0.8 + 0.2 * share(profile.optional) if profile.optional else 0.8


def detect(headers: list[str]) -> tuple[Profile | None, float, str]:
    """(profile, score, confidence): the first of the best; none below 0.6; HIGH needs 0.8 and a lead of 0.15."""
    have = {key(h) for h in headers}
    scores = sorted(((fit(p, have), -i) for i, p in enumerate(PROFILES)), reverse=True)
    (best, i), second = scores[0], scores[1][0]
    if best < 0.6:
        return None, best, "LOW"
    return PROFILES[-i], best, "HIGH" if best >= 0.8 and round(best - second, 9) >= 0.15 else "LOW"


def mapping(profile: Profile, headers: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Field to header: of a field's known headers the first that the file has; overrides win, blank ones don't count."""
    have: dict[str, str] = {}
    for h in headers:
        have.setdefault(key(h), h)
    found = {f: have[key(a)] for f, names in profile.fields.items() for a in [next((a for a in names if key(a) in have), None)] if a}
    return found | {f: h for f, h in (overrides or {}).items() if h and h.strip()}
