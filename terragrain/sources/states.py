"""The contiguous United States and the District of Columbia."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# FIPS code, name, abbreviation, latitude, longitude.
STATES = """
01 Alabama AL 32.7 -86.8
04 Arizona AZ 34.2 -111.7
05 Arkansas AR 34.9 -92.4
06 California CA 37.2 -119.4
08 Colorado CO 39.0 -105.5
09 Connecticut CT 41.6 -72.7
10 Delaware DE 39.0 -75.5
11 District of Columbia DC 38.9 -77.0
12 Florida FL 28.6 -82.4
13 Georgia GA 32.6 -83.4
16 Idaho ID 44.4 -114.6
17 Illinois IL 40.0 -89.2
18 Indiana IN 39.9 -86.3
19 Iowa IA 42.0 -93.5
20 Kansas KS 38.5 -98.4
21 Kentucky KY 37.5 -85.3
22 Louisiana LA 31.0 -91.9
23 Maine ME 45.4 -69.2
24 Maryland MD 39.0 -76.8
25 Massachusetts MA 42.2 -71.5
26 Michigan MI 44.3 -85.4
27 Minnesota MN 46.3 -94.3
28 Mississippi MS 32.7 -89.7
29 Missouri MO 38.4 -92.5
30 Montana MT 47.0 -109.6
31 Nebraska NE 41.5 -99.8
32 Nevada NV 39.3 -116.6
33 New Hampshire NH 43.7 -71.6
34 New Jersey NJ 40.2 -74.7
35 New Mexico NM 34.5 -106.0
36 New York NY 43.0 -75.5
37 North Carolina NC 35.5 -79.4
38 North Dakota ND 47.4 -100.3
39 Ohio OH 40.4 -82.8
40 Oklahoma OK 35.6 -97.5
41 Oregon OR 44.0 -120.5
42 Pennsylvania PA 40.9 -77.8
44 Rhode Island RI 41.7 -71.5
45 South Carolina SC 33.9 -80.9
46 South Dakota SD 44.4 -100.2
47 Tennessee TN 35.8 -86.3
48 Texas TX 31.5 -99.4
49 Utah UT 39.3 -111.7
50 Vermont VT 44.1 -72.7
51 Virginia VA 37.5 -78.8
53 Washington WA 47.4 -120.5
54 West Virginia WV 38.9 -80.5
55 Wisconsin WI 44.6 -89.7
56 Wyoming WY 43.0 -107.5
"""


def state_rows() -> list[tuple[str, str, str, float, float]]:
    out = []
    for line in STATES.strip().splitlines():
        fip, *name, abbrev, lat, lon = line.split()
        out.append((fip, " ".join(name), abbrev, float(lat), float(lon)))
    return out


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(state_rows(), "fip string, name string, abbrev string, lat double, lon double")
