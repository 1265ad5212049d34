"""Explanations of articles, drugs and charges: the first row of a dictionary whose key stands in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compare_key, let

# Label, keys, explanation; earlier rows win. Keys may carry a space that must stand in the text.
GLOSS = [
    ("LEGAL_ARTICLE", ["điều 247"], "Điều 247 BLHS – Tội trồng cây thuốc phiện, cây côca, cây cần sa hoặc các loại cây khác có chứa chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 248"], "Điều 248 BLHS – Tội sản xuất trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 249"], "Điều 249 BLHS – Tội tàng trữ trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 250"], "Điều 250 BLHS – Tội vận chuyển trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 251"], "Điều 251 BLHS – Tội mua bán trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 252"], "Điều 252 BLHS – Tội chiếm đoạt chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 253"], "Điều 253 BLHS – Tội tàng trữ, vận chuyển, mua bán hoặc chiếm đoạt tiền chất dùng vào việc sản xuất trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 254"], "Điều 254 BLHS – Tội sản xuất, tàng trữ, vận chuyển hoặc mua bán phương tiện, dụng cụ dùng vào việc sản xuất hoặc sử dụng trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 255"], "Điều 255 BLHS – Tội tổ chức sử dụng trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 256a"], "Điều 256a BLHS – Tội sử dụng trái phép chất ma túy (bổ sung bởi Luật số 86/2025/QH15, có hiệu lực từ 01/7/2025)."),
    ("LEGAL_ARTICLE", ["điều 256"], "Điều 256 BLHS – Tội chứa chấp việc sử dụng trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 257"], "Điều 257 BLHS – Tội cưỡng bức người khác sử dụng trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 258"], "Điều 258 BLHS – Tội lôi kéo người khác sử dụng trái phép chất ma túy."),
    ("LEGAL_ARTICLE", ["điều 259"], "Điều 259 BLHS – Tội vi phạm quy định về quản lý chất ma túy, tiền chất, thuốc gây nghiện, thuốc hướng thần."),
    ("LEGAL_ARTICLE", ["điều 17"], "Điều 17 BLHS – Quy định về đồng phạm."),
    ("LEGAL_ARTICLE", ["điều 38"], "Điều 38 BLHS – Hình phạt tù có thời hạn."),
    ("LEGAL_ARTICLE", ["điều 50"], "Điều 50 BLHS – Căn cứ quyết định hình phạt."),
    ("LEGAL_ARTICLE", ["điều 51"], "Điều 51 BLHS – Các tình tiết giảm nhẹ trách nhiệm hình sự."),
    ("LEGAL_ARTICLE", ["điều 52"], "Điều 52 BLHS – Các tình tiết tăng nặng trách nhiệm hình sự."),
    ("LEGAL_ARTICLE", ["điều 54"], "Điều 54 BLHS – Quyết định hình phạt dưới mức thấp nhất của khung hình phạt được áp dụng."),
    ("LEGAL_ARTICLE", ["điều 55"], "Điều 55 BLHS – Quyết định hình phạt trong trường hợp phạm nhiều tội (tổng hợp hình phạt)."),
    ("LEGAL_ARTICLE", ["điều 65"], "Điều 65 BLHS – Án treo."),
    ("DRUG", ["methamphetamine", "metamphetamine", "meth", "ma túy đá", "hàng đá", "ma tuý đá", " đá"], "Methamphetamine (ma túy đá, hàng đá) – chất ma túy tổng hợp nhóm kích thích dạng amphetamine (ATS). Khối lượng và hàm lượng Methamphetamine là căn cứ định khung hình phạt tại các Điều 248–252 BLHS."),
    ("DRUG", ["heroin", "heroine", "bạch phiến", "hàng trắng"], "Heroin (bạch phiến, hàng trắng) – chất ma túy nhóm opioid bán tổng hợp từ morphine. Khối lượng heroin là một trong những căn cứ định khung quan trọng, mức cao nhất có thể đến tù chung thân hoặc tử hình."),
    ("DRUG", ["cocaine", "cocain", "côcain"], "Cocaine – chất ma túy nhóm kích thích chiết xuất từ lá côca, thuộc danh mục chất ma túy bị cấm tuyệt đối."),
    ("DRUG", ["ketamine", "ke ", "hàng khay", "khay"], 'Ketamine ("ke") – chất hướng thần bị kiểm soát, thường xuất hiện trong các vụ tổ chức sử dụng/sử dụng trái phép chất ma túy.'),
    ("DRUG", ["mdma", "thuốc lắc", "ecstasy", "kẹo", "hồng phiến"], "MDMA (thuốc lắc, ecstasy) – chất ma túy tổng hợp nhóm kích thích – gây ảo giác, thường gặp trong các vụ tổ chức/sử dụng trái phép chất ma túy."),
    ("DRUG", ["amphetamine"], "Amphetamine – chất ma túy tổng hợp nhóm kích thích (ATS), thường xác định qua kết luận giám định."),
    ("DRUG", ["cần sa tổng hợp", "cỏ mỹ", "thảo mộc phun"], 'Cần sa tổng hợp ("cỏ Mỹ") – nhóm chất kích thích thần kinh tổng hợp (synthetic cannabinoids) được phun tẩm lên thảo mộc, độc tính cao hơn cần sa tự nhiên.'),
    ("DRUG", ["cần sa", "cannabis", "marijuana", "bồ đà", "tài mà", "cỏ", "thảo mộc khô"], "Cần sa (cannabis) – chất ma túy có nguồn gốc thực vật chứa hoạt chất THC, gồm lá, hoa, quả khô; thường gặp trong các vụ trồng, tàng trữ, sử dụng trái phép."),
    ("DRUG", ["nhựa thuốc phiện", "thuốc phiện", "opium", "anh túc"], "Thuốc phiện / nhựa thuốc phiện (opium) – chất ma túy nhóm opioid tự nhiên chiết từ cây thuốc phiện (anh túc)."),
    ("DRUG", ["morphine", "morphin"], "Morphine – chất ma túy nhóm opioid. Lưu ý: nếu chỉ phát hiện qua test nước tiểu hoặc do điều trị y tế thì cần đối chiếu kết luận giám định, không đương nhiên cấu thành tội phạm."),
    ("DRUG", ["ghb", "nước vui"], 'GHB ("nước vui") – chất hướng thần dạng lỏng bị kiểm soát, thường gặp trong các vụ sử dụng trái phép chất ma túy.'),
    ("DRUG", ["cathinone", "muối tắm"], 'Cathinone tổng hợp ("muối tắm") – nhóm chất kích thích tổng hợp mới, bị đưa vào danh mục chất ma túy bị kiểm soát.'),
    ("CHARGE", ["trồng cây", "trồng cần sa", "trồng thuốc phiện", "trồng cây thuốc phiện"], "Tội trồng cây thuốc phiện, cây côca, cây cần sa hoặc các loại cây khác có chứa chất ma túy (Điều 247 BLHS) – áp dụng khi đã được giáo dục, xử phạt hành chính hoặc thuộc các trường hợp luật định mà vẫn trồng."),
    ("CHARGE", ["tiền chất"], "Tội tàng trữ, vận chuyển, mua bán hoặc chiếm đoạt tiền chất dùng vào việc sản xuất trái phép chất ma túy (Điều 253 BLHS)."),
    ("CHARGE", ["phương tiện", "dụng cụ"], "Tội sản xuất, tàng trữ, vận chuyển hoặc mua bán phương tiện, dụng cụ dùng vào việc sản xuất hoặc sử dụng trái phép chất ma túy (Điều 254 BLHS)."),
    ("CHARGE", ["tổ chức sử dụng"], "Tội tổ chức sử dụng trái phép chất ma túy (Điều 255 BLHS) – áp dụng khi người phạm tội chỉ huy, phân công, điều hành, chuẩn bị địa điểm, phương tiện hoặc rủ rê người khác cùng sử dụng trái phép chất ma túy."),
    ("CHARGE", ["chứa chấp"], "Tội chứa chấp việc sử dụng trái phép chất ma túy (Điều 256 BLHS) – áp dụng khi cho người khác mượn, thuê địa điểm thuộc quyền quản lý của mình để sử dụng trái phép chất ma túy."),
    ("CHARGE", ["cưỡng bức"], "Tội cưỡng bức người khác sử dụng trái phép chất ma túy (Điều 257 BLHS) – dùng vũ lực, đe dọa hoặc thủ đoạn khác buộc người khác phải sử dụng trái phép chất ma túy."),
    ("CHARGE", ["lôi kéo", "dụ dỗ"], "Tội lôi kéo người khác sử dụng trái phép chất ma túy (Điều 258 BLHS) – rủ rê, dụ dỗ, xúi giục hoặc bằng thủ đoạn khác khiến người khác sử dụng trái phép chất ma túy."),
    ("CHARGE", ["sử dụng trái phép", "sử dụng ma túy"], "Tội sử dụng trái phép chất ma túy (Điều 256a BLHS, bổ sung năm 2025) – áp dụng với người đang trong thời gian quản lý sau cai, cai nghiện hoặc điều trị nghiện mà vẫn tiếp tục sử dụng trái phép chất ma túy."),
    ("CHARGE", ["tàng trữ"], "Tội tàng trữ trái phép chất ma túy (Điều 249 BLHS) – cất giữ, cất giấu, mang theo hoặc quản lý trái phép chất ma túy mà không nhằm mục đích mua bán, vận chuyển hay sản xuất."),
    ("CHARGE", ["vận chuyển"], "Tội vận chuyển trái phép chất ma túy (Điều 250 BLHS) – dịch chuyển trái phép chất ma túy từ nơi này đến nơi khác dưới bất kỳ hình thức nào."),
    ("CHARGE", ["mua bán"], "Tội mua bán trái phép chất ma túy (Điều 251 BLHS) – mua, bán, vận chuyển/tàng trữ để bán lại, trao đổi hoặc dùng tài sản trái phép để giao dịch chất ma túy."),
    ("CHARGE", ["chiếm đoạt"], "Tội chiếm đoạt chất ma túy (Điều 252 BLHS) – cướp, cưỡng đoạt, trộm cắp, lừa đảo hoặc thủ đoạn khác để chiếm đoạt chất ma túy."),
    ("CHARGE", ["sản xuất"], "Tội sản xuất trái phép chất ma túy (Điều 248 BLHS) – làm ra, điều chế, chiết xuất hoặc tạo ra chất ma túy bằng bất kỳ phương pháp nào."),
]
DEFAULTS = {
    "LEGAL_ARTICLE": "Điều luật hoặc căn cứ pháp lý được Tòa án áp dụng trong bản án.",
    "DRUG": "Chất ma túy được nhận diện trong nội dung bản án hoặc kết luận giám định. Khối lượng và hàm lượng là căn cứ định khung hình phạt theo Bộ luật Hình sự.",
    "CHARGE": "Tội danh được Tòa án xác định trong phần quyết định của bản án.",
}


def describe(label: Column, text: Column) -> Column:
    """The explanation of an entity; empty for labels without a dictionary. One chain of conditions: the dictionary is fixed and small."""

    def explained(key: Column) -> Column:
        chain = None
        for own, keys, explanation in GLOSS:
            hit = F.lit(False)
            for k in keys:
                hit = hit | key.contains(k)
            chain = (F if chain is None else chain).when((label == own) & hit, explanation)
        for own, explanation in DEFAULTS.items():
            chain = chain.when(label == own, explanation)
        return chain.otherwise("")

    # the key is made once, not for each word that is looked for in it
    return let(compare_key(text, quotes=True), explained)
