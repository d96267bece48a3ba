from datetime import datetime

START = datetime(2024, 1, 1)


def values(df, column="value", order="pos"):
    return [r[column] for r in df.orderBy(order).collect()]
