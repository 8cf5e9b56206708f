"""Mapper XML: dynamic tags, includes, parameters, broken files, bindings."""

from __future__ import annotations

from plumbline.sources import mapper

XML = """<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "a" "b">
<mapper namespace="shop.Orders">
  <sql id="cols">id, total</sql>
  <select id="find">select <include refid="cols"/> from orders <where><if test="a">and id = #{id}</if><if test="b"> and state in <foreach open="(" close=")" item="x">#{x}</foreach></if></where> order by ${sort}</select>
  <update id="put">update orders <set>total = #{t}, <if test="s">state = #{s},</if></set> where id = #{id}</update>
  <insert id="add"><selectKey>select 1</selectKey>insert into orders <trim prefix="(" suffix=")" suffixOverrides=",">id, total,</trim> values (#{id}, #{t})</insert>
</mapper>"""


def test_statements_are_flat():
    rows = {r[1]: r for r in mapper.read_mapper(XML, "f.xml")}
    assert rows["find"][3] == "select id, total from orders where id = ? and state in (?) order by __subst__" and rows["find"][5]
    assert rows["put"][3] == "update orders set total = ?, state = ? where id = ?" and not rows["put"][5]
    assert rows["add"][3] == "insert into orders ( id, total ) values (?, ?)"


def test_files_and_bindings(spark):
    files = spark.createDataFrame([("a.xml", XML), ("b.xml", "<mapper"), ("c.xml", "<beans/>"), ("d.xml", None)], "path string, text string")
    st = mapper.mapper_statements(files)
    assert st.where("problem is null").count() == 3 and {r["file"] for r in st.where("problem is not null").collect()} == {"b.xml", "d.xml"}
    sy = spark.createDataFrame([("symbol:shop.Orders#find",), ("symbol:shop.Orders#gone",)], "id string")
    assert [tuple(r) for r in mapper.bind_statements(sy, st).collect()] == [("symbol:shop.Orders#find", "statement:shop.Orders.find", "IMPLEMENTS_STMT", 4)]
