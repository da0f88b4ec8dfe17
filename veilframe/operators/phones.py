"""Telephone numbers, by the plans of the countries.

The patterns are one alternation behind the country codes, which no code is a prefix of, so
that a number is matched by one branch; it runs inside Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (E.164): country codes, and the national numbers behind them as lead and number of digits.
PLANS = {
    "1": r"[2-9]\d{2}[2-9]\d{6}", "7": r"[3-9]\d{9}", "20": r"1[0125]\d{8}|[2-9]\d{7,8}", "27": r"[1-8]\d{8}", "30": r"2\d{9}|69\d{8}", "31": r"[1-9]\d{8}", "32": r"4\d{8}|[1-9]\d{7}", "33": r"[1-9]\d{8}",
    "34": r"[5-9]\d{8}", "36": r"1\d{7}|[2-9]\d{7,8}", "39": r"0\d{5,10}|3\d{8,9}", "40": r"[2379]\d{8}", "41": r"[1-9]\d{8}", "43": r"[1-9]\d{6,12}", "44": r"7\d{9}|[1238]\d{8,9}", "45": r"[2-9]\d{7}", "46": r"[1-9]\d{6,9}",
    "47": r"[2-9]\d{7}", "48": r"[1-9]\d{8}", "49": r"[1-9]\d{5,12}", "51": r"9\d{8}|[1-8]\d{7}", "52": r"1?[2-9]\d{9}", "53": r"[2-7]\d{5,7}", "54": r"9?[1-3]\d{9}", "55": r"[1-9]\d(?:9\d{8}|[2-5]\d{7})", "56": r"[2-9]\d{8}",
    "57": r"3\d{9}|60\d{8}", "58": r"[24]\d{9}", "60": r"1\d{8,9}|[3-9]\d{7,8}", "61": r"[2-478]\d{8}", "62": r"8\d{8,11}|[2-7]\d{6,10}", "63": r"9\d{9}|[2-8]\d{7,9}", "64": r"2\d{7,9}|[3-9]\d{7}", "65": r"[3689]\d{7}",
    "66": r"[689]\d{8}|[2-7]\d{7}", "81": r"[789]0\d{8}|[1-9]\d{8}", "82": r"1\d{8,9}|[2-7]\d{7,9}", "84": r"[35789]\d{8}|2\d{9}", "86": r"1[3-9]\d{9}|10\d{8}|[2-9]\d{8,10}", "90": r"[2-5]\d{9}", "91": r"[1-9]\d{9}",
    "92": r"3\d{9}|[2-9]\d{8,9}|[2-9]\d111\d{6}", "93": r"[2-7]\d{8}", "94": r"[1-9]\d{8}", "95": r"9\d{7,9}|[1-8]\d{5,7}", "98": r"[1-9]\d{9}", "212": r"[5-8]\d{8}", "213": r"[5-7]\d{8}|[1-4]\d{7}", "216": r"[2-9]\d{7}", "218": r"[2-9]\d{7,8}",
    "221": r"[37]\d{8}", "225": r"[02]\d{9}", "233": r"[235]\d{8}", "234": r"[7-9]\d{9}|[1-9]\d{6,7}", "237": r"[26]\d{8}", "244": r"[29]\d{8}", "251": r"[1-59]\d{8}", "254": r"[17]\d{8}|[2-6]\d{6,8}", "255": r"[2-7]\d{8}",
    "256": r"[2-7]\d{8}", "260": r"[279]\d{8}", "351": r"[239]\d{8}", "352": r"[2-9]\d{4,10}", "353": r"8\d{8}|[1-9]\d{6,8}", "354": r"[4-9]\d{6}", "355": r"[2-9]\d{7,8}", "356": r"[2579]\d{7}", "357": r"[279]\d{7}",
    "358": r"[1-9]\d{5,11}", "359": r"[2-9]\d{6,8}", "370": r"[3-9]\d{7}", "371": r"[2-9]\d{7}", "372": r"[3-9]\d{6,7}", "373": r"[2-9]\d{7}", "374": r"[1-9]\d{7}", "375": r"[1-4]\d{8}", "380": r"[3-9]\d{8}", "381": r"[1-9]\d{7,8}",
    "382": r"[2-9]\d{7}", "383": r"[2-9]\d{7}", "385": r"[1-9]\d{7,8}", "386": r"[1-8]\d{7}", "387": r"[3-6]\d{7}", "389": r"[2-8]\d{7}", "420": r"[2-9]\d{8}", "421": r"[2-9]\d{8}", "502": r"[2-7]\d{7}", "503": r"[267]\d{7}",
    "504": r"[237-9]\d{7}", "505": r"[2578]\d{7}", "506": r"[24-8]\d{7}", "507": r"[2-9]\d{6,7}", "591": r"[2-7]\d{7}", "593": r"9\d{8}|[2-7]\d{7}", "595": r"9\d{8}|[2-8]\d{6,8}", "598": r"[249]\d{7}", "852": r"[2-9]\d{7}",
    "853": r"[268]\d{7}", "855": r"[1-9]\d{7,8}", "880": r"1\d{9}|[2-9]\d{6,8}", "886": r"9\d{8}|[2-8]\d{7,8}", "961": r"[13-9]\d{6,7}", "962": r"7\d{8}|[2-6]\d{7}", "964": r"7\d{9}|[1-6]\d{7,8}", "965": r"[2569]\d{7}",
    "966": r"[15]\d{8}", "968": r"[279]\d{7}", "971": r"5\d{8}|[2-479]\d{7}", "972": r"[57]\d{8}|[23489]\d{7}", "973": r"[1367]\d{7}", "974": r"[3-7]\d{7}", "977": r"9\d{9}|[1-9]\d{7}", "994": r"[1-9]\d{8}", "995": r"[3-79]\d{8}",
    "996": r"[2-9]\d{8}", "998": r"[1-9]\d{8}",
}
#: Fixed values (E.164): codes of countries whose numbers are of the usual lengths, without a plan here.
OTHERS = "211 220 222 223 224 226 227 228 229 230 231 232 235 236 238 239 240 241 242 243 245 248 249 250 252 253 257 258 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 376 377 378 423 500 501 508 509 590 592 594 596 597 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 850 856 960 963 967 970 975 976 992 993".split()
_USUAL = r"[1-9]\d{5,9}"
#: How numbers are written at home in the US, Taiwan and Britain.
LOCAL = (r"1?[2-9]\d{2}[2-9]\d{6}", r"0(?:9\d{8}|[2-8]\d{7,8})", r"0(?:7\d{9}|[1238]\d{8,9})")

_ABROAD = "|".join([*(f"{code}0?(?:{plan})" for code, plan in PLANS.items()), f"(?:{'|'.join(OTHERS)})0?{_USUAL}"])
PATTERN = rf"^(?:(?:\+|00|011)(?:{_ABROAD})|{'|'.join(LOCAL)})$"


def is_phone(s: Column) -> Column:
    """Whether a text is a number with its country code, or one as it is written in the US, Taiwan or Britain."""
    plain = F.regexp_replace(F.trim(s), r"[\s().\-/]+", "")
    return plain.rlike(PATTERN) & F.trim(s).rlike(r"^\+?[0-9()][0-9\s().\-/]*$")
