"""Column names, keyword lists and thresholds: what operators share by value.

``k_`` columns describe the promotional competitor's offer, ``n_`` columns the shopping search's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The external column names of the full result and of the upload, in their order.
RESULT_COLUMNS = {
    "kind": "구분", "owner": "담당자", "vendor_name": "업체명", "vendor_code": "업체코드", "code": "Code", "category": "중분류카테고리", "product_name": "상품명",
    "base_qty": "기본수량(1)", "base_price": "판매단가(V포함)", "base_link": "본사상품링크",
    "k_qty": "기본수량(2)", "k_price": "판매가(V포함)(2)", "k_diff": "가격차이(2)", "k_diff_pct": "가격차이(2)(%)", "k_link": "고려기프트 상품링크",
    "n_qty": "기본수량(3)", "n_price": "판매단가(V포함)(3)", "n_diff": "가격차이(3)", "n_diff_pct": "가격차이(3)(%)", "n_supplier": "공급사명",
    "n_link": "네이버 쇼핑 링크", "n_supplier_link": "공급사 상품링크",
    "base_image": "본사 이미지", "k_image": "고려기프트 이미지", "n_image": "네이버 이미지",
}
UPLOAD_COLUMNS = {
    "kind": "구분(승인관리:A/가격관리:P)", "owner": "담당자", "vendor_name": "공급사명", "vendor_code": "공급처코드", "code": "상품코드", "category": "카테고리(중분류)", "product_name": "상품명",
    "base_qty": "본사 기본수량", "base_price": "판매단가1(VAT포함)", "base_link": "본사링크",
    "k_qty": "고려 기본수량", "k_price": "판매단가2(VAT포함)", "k_diff": "고려 가격차이", "k_diff_pct": "고려 가격차이(%)", "k_link": "고려 링크",
    "n_qty": "네이버 기본수량", "n_price": "판매단가3 (VAT포함)", "n_diff": "네이버 가격차이", "n_diff_pct": "네이버가격차이(%)", "n_supplier": "네이버 공급사명",
    "n_link": "네이버 링크", "base_image": "해오름(이미지링크)", "k_image": "고려기프트(이미지링크)", "n_image": "네이버쇼핑(이미지링크)",
}
REQUIRED = ("kind", "owner", "vendor_name", "vendor_code", "code", "category", "product_name", "base_qty", "base_price", "base_link")
NUMERIC = ("base_qty", "base_price", "k_qty", "k_price", "k_diff", "k_diff_pct", "n_qty", "n_price", "n_diff", "n_diff_pct")
IMAGES = ("base_image", "k_image", "n_image")

# Words of promotional sellers, by where they are looked for.
PROMO_SUPPLIER = ("온오프마켓", "답례품", "기프트", "판촉", "기념품", "인쇄", "각인", "제작", "미스터몽키", "홍보", "호갱탈출")
PROMO_SITE = (
    "온오프마켓", "답례품", "기프트", "판촉", "기념품", "인쇄", "각인", "제작", "미스터몽키", "홍보", "호갱탈출", "다조아", "기업판촉", "단체선물", "사은품",
    "홍보물", "판촉물", "기업기념품", "단체주문", "대량구매", "대량주문", "맞춤제작", "로고인쇄", "로고각인", "주문제작", "제품홍보", "기업홍보", "단체구매",
)
PROMO_UPLOAD = ("판촉", "기프트", "답례품", "기념품", "인쇄", "각인", "제작", "호갱", "몽키", "홍보")
SOLD_OUT = ("품절",)
# Fixed values: (words in a seller's name, the label they give), the first that fits.
SUPPLIER_TYPES = (
    (("네이버", "스마트스토어"), "네이버"), (("쿠팡",), "쿠팡"), (("11번가",), "11번가"), (("G마켓", "지마켓"), "G마켓"),
    (("옥션",), "옥션"), (("인터파크",), "인터파크"), (("위메프",), "위메프"), (("티몬",), "티몬"),
)
SUPPLIER_OTHER = "일반"

IMAGE = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("local_path", T.StringType()), ("original_path", T.StringType()), ("original_url", T.StringType()), ("original_crawled_url", T.StringType()), ("source", T.StringType()), ("product_name", T.StringType()), ("similarity", T.DoubleType()), ("product_id", T.StringType()), ("product_page_url", T.StringType()))])


@dataclass(frozen=True)
class Thresholds:
    """The numeric settings of matching and filtering."""

    text: float = 0.65
    image: float = 0.95
    text_floor: dict = field(default_factory=lambda: {"k": 0.2, "n": 0.3})
    image_floor: float = 0.8
    weights: dict = field(default_factory=lambda: {"k": (0.6, 0.4), "n": (0.7, 0.3)})
    n_min: float = 0.35
    n_price_pct: float = 70.0
    n_price_score: float = 0.55
    exact_bonus: float = 0.25
    fuzzy: float = 0.70
    image_filter: dict = field(default_factory=lambda: {"n_image": 0.70, "k_image": 0.65})
    upload_diff: float = -1.0
    quantities: tuple = (300, 500, 1000, 2000)
    k_quantities: tuple = (300, 800, 1100, 2000)
    batch: int = 100
    max_items: dict = field(default_factory=lambda: {"k": 100, "n": 80})
