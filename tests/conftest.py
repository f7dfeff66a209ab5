import datetime as dt
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def fill_harbour(writer):
    """Ships, ports and sailors: labels of two on a node, a loop, parallel edges, an unlabeled node, numbers of two kinds under one name."""
    port = {name: writer.add_node(["Port"], {"name": name, "depth": depth, "opened": opened}) for name, depth, opened in (("Ostra", 12, dt.date(1901, 5, 6)), ("Velden", 8, None), ("Quill", 20, dt.date(1990, 1, 2)))}
    ship = {
        "Marlin": writer.add_node(["Ship"], {"name": "Marlin", "built": 1998, "holds": [3, 4]}),
        "Tern": writer.add_node(["Ship"], {"name": "Tern", "built": 2005}),
        "Otter": writer.add_node(["Ship", "Ferry"], {"name": "Otter", "built": 2011, "seats": 120}),
    }
    sailor = {
        "Ines": writer.add_node(["Sailor", "Pilot"], {"name": "Ines", "age": 41, "pay": 3.5}),
        "Tomas": writer.add_node(["Sailor"], {"name": "Tomas", "age": 29, "pay": 4}),
        "Wren": writer.add_node(["Sailor"], {"name": "Wren", "age": 33}),
    }
    buoy = writer.add_node([], {"name": "Buoy"})
    for s, p, day in (("Marlin", "Ostra", 1), ("Marlin", "Velden", 3), ("Tern", "Ostra", 2), ("Otter", "Ostra", 5), ("Otter", "Ostra", 9), ("Otter", "Quill", 7)):
        writer.add_relationship(ship[s], port[p], "CALLS_AT", {"day": day})
    for who, s, since in (("Ines", "Otter", 2020), ("Ines", "Marlin", 2015), ("Tomas", "Tern", 2018), ("Wren", "Otter", 2021)):
        writer.add_relationship(sailor[who], ship[s], "SERVES_ON", {"since": since})
    writer.add_relationship(sailor["Ines"], sailor["Tomas"], "MENTORS", {})
    writer.add_relationship(sailor["Ines"], sailor["Ines"], "MENTORS", {})
    writer.add_relationship(buoy, port["Quill"], "MARKS", {})


@pytest.fixture(scope="session")
def harbour(spark, tmp_path_factory):
    from graphtables import GraphWriter

    writer = GraphWriter(spark, f"file://{tmp_path_factory.mktemp('harbour')}")
    fill_harbour(writer)
    return writer.write()


@pytest.fixture(scope="session")
def plain_harbour(spark, harbour):
    """The same graph without stored labels, so they have to be looked up."""
    from graphtables import Graph

    return Graph.from_dataframes(spark, {x: n.df.drop("_labels") for x, n in harbour.nodes.items()}, {x: r.df for x, r in harbour.rels.items()}, {x: n.rows for x, n in harbour.nodes.items()})


@pytest.fixture
def run(harbour):
    def go(text, graph=None, **parameters):
        builder = (graph or harbour).query(text)
        for name, value in parameters.items():
            builder.parameter(name, value)
        return [tuple(r) for r in builder.df().collect()]

    return go
