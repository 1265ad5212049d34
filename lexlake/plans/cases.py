"""Wordings on which the rules are known to hold or to fail, as text. Queries deal them out over the rows of orders."""

from __future__ import annotations

#: Predicate: units on which it holds, units on which it fails.
UNITS = {
    "has_drug_name": (["mua heroin", "HÀNG ĐÁ", "cỏ  Mỹ", "ma tuý đá", "thuoc lac"], ["heroinx", "đá lửa", "xcần sa"]),
    "has_real_weight": (["nặng 2,5 gam", "0.3g heroin", "từ 5 gam đến 10 gam", "5 gam trở lên MDMA"], ["từ 5 gam đến dưới mức", "gam", "5 gam trở lên"]),
    "has_crime_action": (["bị cáo tàng trữ", "Bắt quả tang", "mua của H ít ma túy"], ["tàng trữx", "bị cáo ở nhà"]),
    "has_time_signal": (["Khoảng đó", "lúc 5 giờ 30 phút", "ngày mai", "1/2/2020"], ["thời gian", "123"]),
    "has_loc_signal": (["tại nhà", "Phường 5"], ["nhà", "tạix"]),
    "has_drug_or_weight": (["heroin", "nặng 3 gam"], ["3 viên"]),
    "is_noise": (["[3] Về hình phạt: nặng", "Cáo trạng số 5", "Kiểm sát viên"], ["[3] Về hình phạt chính", "mua ma túy"]),
    "is_strict_crime": (["Khoảng 5 giờ tại nhà bị cáo tàng trữ heroin"], ["bị cáo tàng trữ heroin", "Khoảng 5 giờ tại nhà bị cáo tàng trữ gạo"]),
    "keep_drug_mention": (["mua heroin ở chợ", "cất giấu MDMA"], ["nước tiểu dương tính với heroin", "heroin trong danh mục cấm", "mẫu hoàn lại gồm heroin", "mua gạo ở chợ"]),
    "is_relevant_content": (["bị cáo mua heroin về dùng"], ["mua heroin thôi", "test nhanh heroin của bị cáo", "bị cáo đi chợ mua gạo"]),
    "is_section_title": (["NỘI DUNG VỤ ÁN:", "  xét thấy ", "Quyết định :"], ["nội dung vụ án là", "quyết định hình phạt"]),
    "is_useful_negative": (["Nơi cư trú của bị cáo ở xã", "Kết luận giám định số 5 ngày"], ["án phí theo Viện kiểm sát đề nghị", "không có gì ở đây", "NỘI DUNG VỤ ÁN"]),
    "is_reasoning_fact": (
        ["Bị cáo đã có hành vi truy tố nêu rõ", "Khoảng 5 giờ tại nhà bị cáo tàng trữ heroin"],
        ["Viện kiểm sát truy tố bị cáo mua heroin", "[2] Về án phí: đã có hành vi", "ba từ thôi", "bị cáo thành khẩn khai báo tàng trữ heroin"],
    ),
    "relevant_content_para": (["2 gam gì đó", "mua ở chợ", "có chất ma túy"], ["không có gì", "ở chợ"]),
    "relevant_reasoning_para": (["Viện kiểm sát: đã có hành vi", "mua ở chợ", "2 gam"], ["Viện kiểm sát mua 2 gam", "không có gì"]),
    "should_skip_text": (["", "12", "Có đủ cơ sở kết luận:", "Hội đồng xét xử nhận định như sau."], ["1234", "Có đủ cơ sở kết luận: bị cáo"]),
    "valid_weight": (["2,5 gam", "3mg", "khoảng 1 kg"], ["gam", "2 viên", "2 gamx"]),
    "bad_weight_context": (["mẫu hoàn lại 2 gam", "Còn lại sau giám định 1 gam"], ["thu giữ 2 gam"]),
    "bad_drug": ([" Đ2 ", "T"], ["Đ3", "MDMA"]),
    "bad_drug_context": (["Test nhanh MDMA", "mẫu nước tiểu"], ["thu giữ MDMA"]),
    "bad_article": (["Điều 106 BLTTHS", "Điều 320", "Nghị quyết 326"], ["Điều 249", "Điều 38"]),
    "valid_person": (["Lò Văn H", "Mùa A"], ["Lò", "Tòa án nhân", "a b c d e f g"]),
    "valid_time": (["5 giờ sáng", "ngày 1 tháng 2 năm 2020", "Hồi đó", "3/4/2021"], ["hôm qua", "năm 2020"]),
    "bad_time_context": (["ngày thụ lý vụ án"], ["thụ lý việc mua bán", "hôm qua"]),
    "clear_location": (["số 5 đường Lê Lợi", "xã A, huyện B, tỉnh C", "nhà nghỉ X"], ["tại đây", "xã Mường", "huyện", "A, B"]),
    "bad_location_context": (["trú tại xã A", "trụ sở Tòa án nhân dân"], ["trú tại xã A thì bị bắt quả tang", "ở chợ"]),
    "valid_sentence": (["02 năm tù", "phạt tiền 5.000.000 đồng"], ["án phí và tù", "5.000.000 đồng"]),
}

#: Label, text and context of an entity, and its cleaned text (none: it is dropped).
ENTITIES = [
    ("DRUG", ' "Metamphetamine", ', "thu giữ", "Methamphetamine"), ("DRUG", "heroin", "thu giữ", "Heroine"), ("DRUG", "hàng khay", "mua", "Ketamine"), ("DRUG", "MA TÚY ĐÁ", "mua", "ma túy đá"), ("DRUG", "Đ2", "thu giữ", None),
    ("DRUG", "heroin", "mẫu nước tiểu dương tính", None), ("DRUG", " ., ", "thu giữ", None), ("DRUG_WEIGHT", "2,5  g.", "thu giữ", "2,5 gam"), ("DRUG_WEIGHT", "3 viên", "thu giữ", None),
    ("DRUG_WEIGHT", "2 gam", "mẫu hoàn lại", None), ("CRIME_TIME", "Khoảng 5 giờ", "thụ lý", None), ("CRIME_TIME", "Khoảng 5 giờ", "bắt quả tang", "Khoảng 5 giờ"), ("CRIME_TIME", "hôm qua", "bắt quả tang", None),
    ("CRIME_LOC", "số 5 đường Lê Lợi", "mua", "số 5 đường Lê Lợi"), ("CRIME_LOC", "tại đây", "mua", None), ("CRIME_LOC", "số 5 đường Lê Lợi", "nơi thường trú", None), ("DEFENDANT", "Lò Văn H phạm tội", "", "Lò Văn H"),
    ("PERSON", "Tòa án nhân dân", "", None), ("CHARGE", "“Tàng trữ  trái phép chất ma túy”", "", "Tàng trữ trái phép chất ma túy"), ("CHARGE", "Trộm cắp tài sản", "", None), ("LEGAL_ARTICLE", "Điều  249", "", "Điều 249"),
    ("LEGAL_ARTICLE", "Điều 106", "", None), ("SENTENCE", "02 năm  tù", "", "02 năm tù"), ("SENTENCE", "án phí và tù", "", None),
]


def sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"
