"""Golden rows for rules that SQL can't restate: look-around, Vietnamese word borders, order of conditions."""

import pytest
from pyspark.sql import functions as F

from lexlake.functions import gloss
from lexlake.functions import predicates as P
from lexlake.functions import text as T
from lexlake.operators import entities as E
from lexlake.operators import segment as S


def values(spark, function, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r[0] for r in frame.select(function(F.col("text")).alias("v"), "k").orderBy("k").select("v").collect()]


TEXT = [
    (T.norm_drug, {' "Metamphetamine", ': "Methamphetamine", "heroin": "Heroine", "heroin trắng": "heroin trắng", "hàng khay": "Ketamine", "Amphetamin": "Amphetamin", "amphetamine": "Amphetamine", "MA TÚY ĐÁ": "ma túy đá", "đá": "đá", "thảo mộc khô": "Cần sa", "metamphetamin": "metamphetamin"}),
    (T.norm_weight, {"2,5  g.": "2,5 gam", "0,2g": "0,2g", "3 Gram": "3 gam"}),
    (T.norm_person, {"Lò Văn H phạm tội": "Lò Văn H", " Mùa A T. ": "Mùa A T", "Bùi Phúc T về tội": "Bùi Phúc T"}),
    (T.norm_charge, {"“Tàng trữ  trái phép chất ma túy”": "Tàng trữ trái phép chất ma túy"}),
    (T.capitalize_sentences, {"điểm c khoản 1 điều 249 blhs. tội mua bán": "Điểm c khoản 1 Điều 249 BLHS. Tội mua bán", "mdma của hđxx": "MDMA của HĐXX"}),
    (T.fold_upper, {"Đường Lê Lợi, ấp ữỹ": "DUONG LE LOI, AP UY", "straße": "STRAẞE"}),
    (T.normalize, {"bịcáo  Tốtụng \u201ca\u201d \u2013\u200b": 'bị cáo Tố tụng "a" -', "ma tuý": "ma túy", "a\u0306\u0301": "ắ"}),
    (lambda c: T.normalize(c, "annotated"), {" a , b ;\ufffd c ": "a, b; c", "mat úy": "ma túy"}),
    (T.clean_raw, {"a \n12\n---\n\n\n\nĐộc lập - Tự do - Hạnh phúc\nb": "a\n\nb"}),
    (T.strip_tail_noise, {"Bắt quả tang. Vật chứng thu giữ: 1 gói": "Bắt quả tang.", "a * Vật chứng thu giữ : x\ny": "a"}),
    (T.source_key, {"BA 12 (3)": "BA 12", "BA (1) x": "BA (1) x"}),
    (T.slug, {"Bản án số 5.pdf": "ban_an_so_5", "": "file", "...": "file"}),
    (lambda c: gloss.describe(F.lit("LEGAL_ARTICLE"), c), {"Điều 256a BLHS": gloss.GLOSS[9][2], "Điều 256": gloss.GLOSS[10][2], "Điều 999": gloss.DEFAULTS["LEGAL_ARTICLE"]}),
]


@pytest.mark.parametrize("n", range(len(TEXT)))
def test_text(spark, n):
    function, cases = TEXT[n]
    assert values(spark, function, list(cases)) == list(cases.values())


PREDICATES = [
    (P.has_drug_name, ["mua heroin", "HÀNG ĐÁ", "cỏ  Mỹ", "ma tuý đá", "thuoc lac"], ["heroinx", "đá lửa", "xcần sa"]),
    (P.has_real_weight, ["nặng 2,5 gam", "0.3g heroin", "từ 5 gam đến 10 gam", "5 gam trở lên MDMA"], ["từ 5 gam đến dưới mức", "gam", "5 gam trở lên"]),
    (P.has_time_signal, ["Khoảng đó", "lúc 5 giờ 30 phút", "ngày mai", "1/2/2020"], ["thời gian", "123"]),
    (P.has_loc_signal, ["tại nhà", "Phường 5"], ["nhà", "tạix"]),
    (P.is_noise, ["[3] Về hình phạt: nặng", "Cáo trạng số 5", "Kiểm sát viên"], ["[3] Về hình phạt chính", "mua ma túy"]),
    (P.is_reasoning_fact, ["Bị cáo đã có hành vi truy tố nêu rõ", "Khoảng 5 giờ tại nhà bị cáo tàng trữ heroin"], ["Viện kiểm sát truy tố bị cáo mua heroin", "[2] Về án phí: đã có hành vi", "ba từ thôi", "bị cáo thành khẩn khai báo tàng trữ heroin"]),
    (P.is_useful_negative, ["Nơi cư trú của bị cáo ở xã", "Kết luận giám định số 5 ngày"], ["án phí theo Viện kiểm sát đề nghị", "không có gì ở đây", "NỘI DUNG VỤ ÁN"]),
    (P.relevant_reasoning_para, ["Viện kiểm sát: đã có hành vi", "mua ở chợ", "2 gam"], ["Viện kiểm sát mua 2 gam", "không có gì"]),
    (P.should_skip_text, ["", "12", "Có đủ cơ sở kết luận:", "Hội đồng xét xử nhận định như sau."], ["1234", "Có đủ cơ sở kết luận: bị cáo"]),
    (P.valid_person, ["Lò Văn H", "Mùa A"], ["Lò", "Tòa án nhân", "a b c d e f g"]),
    (P.clear_location, ["số 5 đường Lê Lợi", "xã A, huyện B, tỉnh C", "nhà nghỉ X"], ["tại đây", "xã Mường", "huyện", "A, B"]),
    (P.bad_article, ["Điều 106 BLTTHS", "Điều 320", "Nghị quyết 326"], ["Điều 249", "Điều 38"]),
    (P.valid_sentence, ["02 năm tù", "phạt tiền 5.000.000 đồng"], ["án phí và tù", "5.000.000 đồng"]),
    (P.bad_time_context, ["ngày thụ lý vụ án"], ["thụ lý việc mua bán", "hôm qua"]),
]


@pytest.mark.parametrize("n", range(len(PREDICATES)))
def test_predicates(spark, n):
    function, yes, no = PREDICATES[n]
    assert values(spark, function, yes + no) == [True] * len(yes) + [False] * len(no)


def test_sentences_and_units(spark):
    text = "NỘI DUNG VỤ ÁN:\nCâu một. Câu hai; Ba. [2] Bốn năm.\n12\nVề vật chứng: x"
    assert values(spark, S.to_units, [text])[0] == ["NỘI DUNG VỤ ÁN:", "Câu một.", "Câu hai;", "Ba.", "[2] Bốn năm."]
    assert values(spark, S.split_sentences, ["A b. c D. Đ? 5"])[0] == ["A b. c D.", "Đ? 5"]


def test_packing_of_sentences(spark):
    text = " ".join(f"Câu {k} có sáu từ đây." for k in range(50))
    chunks = values(spark, lambda c: S.pack_sentences(c, 40), [text, "một hai " * 50, "ngắn"])
    assert [len(c.split()) for c in chunks[0]] == [36] * 8 + [12] and " ".join(chunks[0]) == text
    assert [len(c.split()) for c in chunks[1]] == [40, 40, 20] and chunks[2] == ["ngắn"]


def test_decision_clauses(spark):
    text = "QUYẾT ĐỊNH:\nTuyên bố chung.\n1. Một khoản 2. Hai\n12\n4. Bốn\n5. Về án phí: x\nNơi nhận: y"
    assert values(spark, S.decision_clauses, [text])[0] == ["Tuyên bố chung.", "1. Một khoản", "2. Hai"]
    assert values(spark, S.decision_clauses_train, ["QUYẾT ĐỊNH: 1. Một x\n3. Ba y 2. VE AN PHI z"])[0] == ["1. Một x", "3. Ba y"]


def test_headings(spark):
    found = values(spark, S.detect_heading, ["Nội dung vụ án - POSITIVE", "Nhận định của Tòa án:", "NGỮ CẢNH KHÔNG GÁN NHÃN", "Quyết định là"])
    assert [r and r["section"] for r in found] == ["noi_dung", "nhan_dinh", "negative", None]
    split = values(spark, S.split_heading_prefix, ["QUYẾT ĐỊNH: Tuyên bố bị cáo", "NỘI DUNG VỤ ÁN Theo các tài liệu có", "khác"])
    assert [(r["section"], r["rest"]) for r in split] == [("quyet_dinh", "Tuyên bố bị cáo"), (None, "NỘI DUNG VỤ ÁN Theo các tài liệu có"), (None, "khác")]


def test_nested_rules_and_order(spark):
    text = "1. Áp dụng điểm c khoản 1 Điều 249; Điều 106 Bộ luật. Xử phạt bị cáo Lò Văn H 02 (hai) năm tù về tội Mua bán trái phép chất ma túy. Phạt tiền 5.000.000 đồng."
    records = spark.createDataFrame([(1, "quyet_dinh", 0, text), (1, "noi_dung", 1, text)], "doc_id long, section string, record_idx int, text string")
    found = E.order_entities(E.dedupe_entities(E.rule_entities(records)), zero_last=True).orderBy("ord").collect()
    got = [(r["label"], r["text"]) for r in found]
    assert [t for label, t in got if label == "LEGAL_ARTICLE"] == ["điểm c khoản 1 Điều 249", "khoản 1 Điều 249", "Điều 249"]
    assert ("PERSON", "Lò Văn H") in got and ("CHARGE", "Mua bán trái phép chất ma túy") in got and ("SENTENCE", "Phạt tiền 5.000.000 đồng") in got
    assert all(text[r["start"] : r["end"]].strip(" .,;") == r["text"] for r in found)
    assert {r["section"] for r in found} == {"quyet_dinh"}
