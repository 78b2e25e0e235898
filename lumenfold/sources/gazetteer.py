"""Well-known places of Japan with rough positions, for names without any lookup service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, latitude, longitude. The order decides between equally near places.
GAZETTEER = (
    ("札幌", 43.0618, 141.3545),
    ("函館", 41.7687, 140.7288),
    ("青森", 40.8246, 140.7406),
    ("盛岡", 39.7036, 141.1527),
    ("仙台", 38.2688, 140.8721),
    ("秋田", 39.7186, 140.1024),
    ("山形", 38.2404, 140.3633),
    ("福島", 37.7503, 140.4676),
    ("水戸", 36.3418, 140.4468),
    ("宇都宮", 36.5551, 139.8828),
    ("前橋", 36.3895, 139.0634),
    ("さいたま", 35.8617, 139.6455),
    ("千葉", 35.6073, 140.1063),
    ("横浜", 35.4437, 139.638),
    ("鎌倉", 35.3192, 139.5466),
    ("箱根", 35.2324, 139.1069),
    ("新潟", 37.9161, 139.0364),
    ("富山", 36.6953, 137.2113),
    ("金沢", 36.5613, 136.6562),
    ("福井", 36.0652, 136.2216),
    ("甲府", 35.6642, 138.5684),
    ("長野", 36.6513, 138.181),
    ("軽井沢", 36.3487, 138.597),
    ("岐阜", 35.3912, 136.7223),
    ("静岡", 34.9769, 138.3831),
    ("浜松", 34.7108, 137.7261),
    ("名古屋", 35.1815, 136.9066),
    ("津", 34.7303, 136.5086),
    ("伊勢", 34.4873, 136.7092),
    ("大津", 35.0045, 135.8686),
    ("京都", 35.0116, 135.7681),
    ("大阪", 34.6937, 135.5023),
    ("神戸", 34.6901, 135.1955),
    ("奈良", 34.6851, 135.8048),
    ("和歌山", 34.226, 135.1675),
    ("鳥取", 35.5039, 134.2377),
    ("松江", 35.4723, 133.0505),
    ("岡山", 34.6555, 133.9195),
    ("広島", 34.3853, 132.4553),
    ("山口", 34.1785, 131.4737),
    ("徳島", 34.0658, 134.5593),
    ("高松", 34.3401, 134.0434),
    ("松山", 33.8416, 132.7657),
    ("高知", 33.5597, 133.5311),
    ("福岡", 33.5904, 130.4017),
    ("北九州", 33.8835, 130.8752),
    ("佐賀", 33.2494, 130.2988),
    ("長崎", 32.7503, 129.8779),
    ("熊本", 32.8032, 130.7079),
    ("大分", 33.2382, 131.6126),
    ("別府", 33.2846, 131.4914),
    ("宮崎", 31.9077, 131.4202),
    ("鹿児島", 31.5602, 130.5581),
    ("那覇", 26.2124, 127.6809),
    ("石垣島", 24.3406, 124.1558),
    ("宮古島", 24.8055, 125.2811),
    ("東京駅", 35.6812, 139.7671),
    ("皇居", 35.6852, 139.7528),
    ("銀座", 35.6717, 139.765),
    ("新宿", 35.6896, 139.7006),
    ("渋谷", 35.658, 139.7016),
    ("原宿", 35.6702, 139.7027),
    ("表参道", 35.6659, 139.7126),
    ("池袋", 35.7295, 139.7109),
    ("上野", 35.7138, 139.7773),
    ("浅草", 35.7148, 139.7967),
    ("東京スカイツリー", 35.7101, 139.8107),
    ("東京タワー", 35.6586, 139.7454),
    ("お台場", 35.6297, 139.7756),
    ("秋葉原", 35.6984, 139.7731),
    ("六本木", 35.6628, 139.7314),
    ("品川", 35.6285, 139.7387),
    ("明治神宮", 35.6764, 139.6993),
    ("築地", 35.6655, 139.7708),
    ("東京ディズニーランド", 35.6329, 139.8804),
    ("高尾山", 35.6252, 139.2438),
    ("清水寺", 34.9949, 135.785),
    ("祇園", 35.0037, 135.7752),
    ("伏見稲荷大社", 34.9671, 135.7727),
    ("金閣寺", 35.0394, 135.7292),
    ("嵐山", 35.0094, 135.6737),
    ("京都駅", 34.9858, 135.7588),
    ("大阪城", 34.6873, 135.5259),
    ("道頓堀", 34.6687, 135.5011),
    ("通天閣", 34.6524, 135.5063),
    ("ユニバーサル・スタジオ・ジャパン", 34.6658, 135.4323),
    ("海遊館", 34.6545, 135.4289),
    ("神戸三宮", 34.6947, 135.1979),
    ("奈良公園", 34.685, 135.843),
    ("東大寺", 34.6889, 135.8398),
    ("富士山", 35.3606, 138.7274),
    ("河口湖", 35.5171, 138.7529),
    ("日光東照宮", 36.7581, 139.5989),
    ("厳島神社", 34.2959, 132.3199),
    ("出雲大社", 35.4018, 132.6853),
    ("白川郷", 36.2578, 136.9063),
    ("兼六園", 36.5622, 136.6624),
    ("姫路城", 34.8394, 134.6939),
    ("原爆ドーム", 34.3955, 132.4536),
    ("首里城", 26.217, 127.7194),
    ("美ら海水族館", 26.6944, 127.878),
    ("知床", 44.0742, 145.0989),
    ("小樽", 43.1907, 140.9947),
    ("富良野", 43.3421, 142.3835),
    ("羽田空港", 35.5494, 139.7798),
    ("成田空港", 35.772, 140.3929),
    ("関西国際空港", 34.4342, 135.2441),
    ("中部国際空港", 34.8584, 136.8054),
    ("新千歳空港", 42.7752, 141.6923),
    ("福岡空港", 33.5859, 130.451),
    ("那覇空港", 26.1958, 127.646),
)


def gazetteer_table(spark: SparkSession) -> DataFrame:
    """The places as a table (ord, name, lat, lon), as `lumenfold.operators.nearest` takes them; any larger one does as well."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(GAZETTEER)], "ord int, name string, lat double, lon double")
