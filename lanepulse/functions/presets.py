"""Fixed places: the bridges over the Han river from west to east, and a gazetteer of towns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, latitude, longitude.
BRIDGES = (
    ("일산대교", 37.6648, 126.7418), ("김포대교", 37.6215, 126.7860), ("행주대교", 37.5985, 126.8195), ("방화대교", 37.5850, 126.8300),
    ("가양대교", 37.5750, 126.8560), ("성산대교", 37.5525, 126.8905), ("양화대교", 37.5430, 126.9020), ("서강대교", 37.5410, 126.9250),
    ("마포대교", 37.5340, 126.9400), ("원효대교", 37.5280, 126.9490), ("한강대교", 37.5170, 126.9580), ("동작대교", 37.5090, 126.9800),
    ("반포대교", 37.5130, 126.9960), ("한남대교", 37.5260, 127.0110), ("동호대교", 37.5350, 127.0200), ("성수대교", 37.5375, 127.0330),
    ("영동대교", 37.5310, 127.0440), ("청담대교", 37.5265, 127.0590), ("잠실대교", 37.5215, 127.0850), ("올림픽대교", 37.5270, 127.1030),
    ("천호대교", 37.5395, 127.1120), ("광진교", 37.5450, 127.1130), ("구리암사대교", 37.5590, 127.1230), ("강동대교", 37.5530, 127.1480),
    ("미사대교", 37.5700, 127.1860), ("팔당대교", 37.5340, 127.2400),
)

#: Name, latitude, longitude.
TOWNS = (
    ("서울", 37.5665, 126.9780), ("부산", 35.1796, 129.0756), ("대구", 35.8714, 128.6014), ("인천", 37.4563, 126.7052), ("광주", 35.1595, 126.8526),
    ("대전", 36.3504, 127.3845), ("울산", 35.5384, 129.3114), ("세종", 36.4801, 127.2890), ("수원", 37.2636, 127.0286), ("성남", 37.4200, 127.1267),
    ("용인", 37.2411, 127.1776), ("안산", 37.3219, 126.8309), ("안양", 37.3943, 126.9568), ("평택", 36.9921, 127.1128), ("화성", 37.1995, 126.8312),
    ("오산", 37.1498, 127.0772), ("이천", 37.2720, 127.4350), ("여주", 37.2983, 127.6372), ("양평", 37.4917, 127.4875), ("구리", 37.5943, 127.1296),
    ("남양주", 37.6360, 127.2165), ("하남", 37.5393, 127.2149), ("의정부", 37.7381, 127.0337), ("포천", 37.8949, 127.2003), ("양주", 37.7853, 127.0458),
    ("파주", 37.7599, 126.7802), ("김포", 37.6152, 126.7156), ("고양", 37.6584, 126.8320), ("일산", 37.6584, 126.7700), ("시흥", 37.3800, 126.8029),
    ("광명", 37.4786, 126.8646), ("판교", 37.3947, 127.1112), ("천안", 36.8151, 127.1139), ("아산", 36.7898, 127.0018), ("청주", 36.6424, 127.4890),
    ("충주", 36.9910, 127.9259), ("제천", 37.1326, 128.1910), ("공주", 36.4465, 127.1190), ("논산", 36.1871, 127.0987), ("당진", 36.8898, 126.6459),
    ("서산", 36.7848, 126.4503), ("홍성", 36.6012, 126.6608), ("보령", 36.3333, 126.6127), ("서천", 36.0803, 126.6919), ("춘천", 37.8813, 127.7298),
    ("원주", 37.3422, 127.9202), ("강릉", 37.7519, 128.8761), ("속초", 38.2070, 128.5918), ("동해", 37.5247, 129.1143), ("삼척", 37.4499, 129.1652),
    ("홍천", 37.6970, 127.8886), ("횡성", 37.4917, 127.9850), ("평창", 37.3708, 128.3903), ("양양", 38.0754, 128.6190), ("인제", 38.0697, 128.1707),
    ("전주", 35.8242, 127.1480), ("군산", 35.9676, 126.7366), ("익산", 35.9483, 126.9577), ("정읍", 35.5699, 126.8559), ("남원", 35.4164, 127.3904),
    ("목포", 34.8118, 126.3922), ("순천", 34.9507, 127.4872), ("여수", 34.7604, 127.6622), ("광양", 34.9407, 127.6959), ("나주", 35.0160, 126.7108),
    ("무안", 34.9904, 126.4817), ("해남", 34.5733, 126.5989), ("포항", 36.0190, 129.3435), ("경주", 35.8562, 129.2247), ("구미", 36.1195, 128.3446),
    ("김천", 36.1398, 128.1136), ("안동", 36.5684, 128.7294), ("영천", 35.9733, 128.9386), ("경산", 35.8251, 128.7414), ("상주", 36.4109, 128.1590),
    ("영주", 36.8057, 128.6240), ("창원", 35.2280, 128.6811), ("마산", 35.2140, 128.5813), ("진주", 35.1800, 128.1076), ("김해", 35.2285, 128.8894),
    ("양산", 35.3350, 129.0373), ("통영", 34.8544, 128.4331), ("거제", 34.8806, 128.6211), ("밀양", 35.5038, 128.7467), ("사천", 35.0037, 128.0643),
    ("하동", 35.0674, 127.7513), ("함양", 35.5205, 127.7251), ("거창", 35.6867, 127.9095), ("대관령", 37.6874, 128.7593), ("문산", 37.8561, 126.7853),
    ("청평", 37.7358, 127.4250),
)


def bridges(spark: SparkSession) -> DataFrame:
    """(point, place, plat, plon), numbered from west to east."""
    return spark.createDataFrame([(k + 1, *b) for k, b in enumerate(BRIDGES)], "point int, place string, plat double, plon double")


def gazetteer(spark: SparkSession) -> DataFrame:
    """(place, lat, lon) of normalised town names."""
    return spark.createDataFrame(list(TOWNS), "place string, lat double, lon double")
