"""Segment marketing (K1-K8): strategy lookup, campaign plan and timeline,
A/B plans with group assignment, personal recommendations, report."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import hash_unit

# The reference's strategy texts per segment, in its order
# (description, characteristics, strategies, channels, budget priority,
# expected ROI). Results must reproduce these strings exactly.
SEGMENT_STRATEGIES = {
    "Champions": {
        "description": "冠军客户 - 最近购买、高频、高消费",
        "characteristics": ["高忠诚度", "高价值", "活跃"],
        "strategies": ["提供 VIP 专属优惠和早期访问权", "邀请参与新品试用和反馈", "推荐高价值产品和增值服务",
                       "建立品牌大使计划", "提供个性化推荐和专属客服"],
        "channels": ["Email", "APP 推送", "专属客服"],
        "budget_priority": "高",
        "expected_roi": "非常高",
    },
    "Loyal Customers": {
        "description": "忠诚客户 - 经常购买，消费稳定",
        "characteristics": ["稳定消费", "品牌忠诚", "中等频率"],
        "strategies": ["提供忠诚度奖励和积分计划", "推荐相关产品和交叉销售", "发送个性化优惠券",
                       "邀请参加会员专属活动", "提供订阅服务优惠"],
        "channels": ["Email", "短信", "APP 推送"],
        "budget_priority": "中高",
        "expected_roi": "高",
    },
    "New Customers": {
        "description": "新客户 - 最近购买但频率低",
        "characteristics": ["新注册", "首次购买", "潜力大"],
        "strategies": ["发送欢迎礼包和首单优惠", "提供新手引导和使用教程", "推荐热门产品和畅销品",
                       "设置新客专属任务奖励", "建立新客培育流程"],
        "channels": ["Email", "短信", "APP 推送", "社交媒体"],
        "budget_priority": "高",
        "expected_roi": "中高",
    },
    "Potential Loyalists": {
        "description": "潜力忠诚客户 - 有成为忠诚客户的潜力",
        "characteristics": ["中等活跃", "有潜力", "需要培养"],
        "strategies": ["提供会员升级激励", "推荐高评价产品", "发送限时优惠活动",
                       "建立互动和参与机制", "提供个性化内容推荐"],
        "channels": ["Email", "APP 推送", "社交媒体"],
        "budget_priority": "中",
        "expected_roi": "中高",
    },
    "Promising": {
        "description": "有希望客户 - 新客户但表现良好",
        "characteristics": ["新客", "有购买意愿", "需要引导"],
        "strategies": ["提供第二次购买激励", "发送产品使用指南", "推荐相关配件和补充品",
                       "建立新客培育邮件序列", "提供限时折扣券"],
        "channels": ["Email", "短信", "APP 推送"],
        "budget_priority": "中",
        "expected_roi": "中",
    },
    "At Risk": {
        "description": "需关注客户 - 曾经活跃但最近不活跃",
        "characteristics": ["曾经高价值", "活跃度下降", "流失风险"],
        "strategies": ["发送唤醒优惠和召回活动", "提供特别折扣和限时优惠", "询问反馈和改进建议",
                       "推送新品和热门产品", "建立流失预警和干预机制"],
        "channels": ["Email", "短信", "电话"],
        "budget_priority": "高",
        "expected_roi": "中",
    },
    "Hibernating": {
        "description": "休眠客户 - 长时间未购买",
        "characteristics": ["长时间未活跃", "曾经购买", "需要唤醒"],
        "strategies": ["发送强力召回优惠", "提供大幅折扣和买赠活动", "推送品牌动态和新品",
                       "建立休眠客户唤醒计划", "考虑再营销活动"],
        "channels": ["Email", "短信", "再营销广告"],
        "budget_priority": "低中",
        "expected_roi": "低中",
    },
    "Lost": {
        "description": "流失客户 - 长时间未购买且价值低",
        "characteristics": ["长期未活跃", "低价值", "高流失风险"],
        "strategies": ["发送最后召回优惠", "提供超值优惠和清仓活动", "收集流失原因反馈",
                       "降低联系频率避免打扰", "考虑从活跃名单中移除"],
        "channels": ["Email", "再营销广告"],
        "budget_priority": "低",
        "expected_roi": "低",
    },
    "Regular": {
        "description": "普通客户 - 表现中等",
        "characteristics": ["一般活跃", "中等价值", "大多数客户"],
        "strategies": ["提供常规促销和折扣", "推荐个性化产品", "发送定期通讯和更新",
                       "建立客户参与计划", "提供积分和奖励"],
        "channels": ["Email", "APP 推送", "社交媒体"],
        "budget_priority": "中",
        "expected_roi": "中",
    },
}

# A/B test templates.
AB_TEST_TEMPLATES = {
    "discount": {"name": "折扣力度测试", "variants": ["8 折优惠", "满 100 减 30"],
                 "metrics": ["转化率", "客单价", "ROI"], "sample_size": "每组至少 1000 人", "duration": "7-14 天"},
    "subject_line": {"name": "邮件主题行测试", "variants": ["直接型 vs 好奇型", "长标题 vs 短标题"],
                     "metrics": ["打开率", "点击率", "转化率"], "sample_size": "每组至少 500 人", "duration": "3-7 天"},
    "cta": {"name": "行动号召测试", "variants": ["立即购买 vs 了解详情", "不同按钮颜色"],
            "metrics": ["点击率", "转化率"], "sample_size": "每组至少 300 人", "duration": "5-10 天"},
    "timing": {"name": "发送时间测试", "variants": ["早上 9 点 vs 晚上 8 点", "工作日 vs 周末"],
               "metrics": ["打开率", "点击率", "转化率"], "sample_size": "每组至少 500 人", "duration": "7-14 天"},
}

# Campaign phases and their activities, plan texts, report texts.
PHASES = ["准备期", "启动期", "执行期", "收尾期"]
PHASE_ACTIVITIES = {
    "准备期": ["确定目标受众和细分群体", "设计创意素材和文案", "设置追踪和分析系统", "准备 A/B 测试方案"],
    "启动期": ["发送预热邮件/通知", "启动社交媒体宣传", "开始小范围测试", "监控初始反馈"],
    "执行期": ["全面推广活动", "持续优化投放策略", "进行 A/B 测试", "收集用户反馈"],
    "收尾期": ["活动效果分析", "生成总结报告", "规划后续跟进", "归档学习经验"],
}
EXPECTED_OUTCOMES = {"conversion_lift": "10-25%", "revenue_increase": "15-30%",
                     "customer_retention": "5-15% 提升", "roi": "3:1 - 5:1"}
CAMPAIGN_RECOMMENDATIONS = ["优先关注高价值细分群体 (Champions, Loyal Customers)", "为不同群体定制个性化内容",
                            "设置明确的转化目标和 KPI", "进行 A/B 测试优化效果", "实时监控并调整策略"]
AB_HYPOTHESIS = "变体 B 比变体 A 在关键指标上有显著提升"
AB_SUCCESS = "统计显著性 p < 0.05，提升幅度 > 5%"
AB_STEPS = ["确定测试目标和假设", "设计测试变体", "随机分配测试群体", "设置数据追踪", "运行测试并监控",
            "分析结果并得出结论", "实施获胜方案"]
PRIORITY_ACTIONS = ["立即启动 Champions 客户维护计划", "针对 At Risk 客户实施召回活动",
                    "为 New Customers 设计培育流程", "优化 Loyal Customers 的忠诚度计划"]
BUDGET_RECOMMENDATIONS = {"customer_retention": "40%", "customer_acquisition": "30%",
                          "reactivation": "20%", "testing_optimization": "10%"}
EXPECTED_IMPACT = {"revenue_lift": "15-25%", "retention_improvement": "10-20%",
                   "customer_lifetime_value": "提升 20-30%", "marketing_roi": "提升 2-3 倍"}
HIGH_VALUE_SEGMENTS = ["Champions", "Loyal Customers"]
AT_RISK_SEGMENTS = ["At Risk", "Lost"]
# Personal recommendation rule texts (F14) in rule order.
RULE_TEXTS = ["推荐 VIP 专属产品和早期访问权", "推荐高价值产品和增值服务", "发送召回优惠和限时折扣",
              "提供新客引导和第二次购买激励"]
SUMMARY_TEMPLATE = ("总客户数：{total}。高价值客户占比：{share}%。"
                    "建议重点关注 Champions, Loyal Customers 群体的维护和增值。")


def strategy_table(spark: SparkSession) -> DataFrame:
    """The 9-row strategy dimension (K1)."""
    rows = [(seg, v["description"], v["characteristics"], v["strategies"], v["channels"],
             v["budget_priority"], v["expected_roi"]) for seg, v in SEGMENT_STRATEGIES.items()]
    return spark.createDataFrame(rows, "segment string, description string, characteristics array<string>, "
                                       "strategies array<string>, channels array<string>, budget_priority string, "
                                       "expected_roi string")


def _first_present(df: DataFrame, names):
    return next((c for c in names if c in df.columns), None)


def segment_strategy(customers: DataFrame, segment: str | None = None) -> DataFrame:
    """Strategy rows with per-segment statistics (K1, K2): customer_count,
    mean of the first of monetary/ltv/total_spend, mean of the first of
    frequency/days_since_last_purchase/recency present. Unknown segment ->
    one row with an ``error`` text."""
    spark = customers.sparkSession
    if segment is not None and segment not in SEGMENT_STRATEGIES:
        return spark.createDataFrame([(f"未知的细分群体：{segment}",)], "error string")
    value_col = _first_present(customers, ["monetary", "ltv", "total_spend"])
    act_col = _first_present(customers, ["frequency", "days_since_last_purchase", "recency"])
    aggs = [F.count(F.lit(1)).alias("customer_count")]
    if value_col:
        aggs.append(F.avg(value_col).alias(f"avg_{value_col}"))
    if act_col:
        aggs.append(F.avg(act_col).alias(f"avg_{act_col}"))
    stats = customers.groupBy("segment").agg(*aggs)
    out = strategy_table(spark).join(F.broadcast(stats), "segment", "left")
    if segment is not None:
        out = out.where(F.col("segment") == segment)
    return out


def campaign_plan(spark: SparkSession, segments, budget: float | None = None, duration_days: int = 30) -> DataFrame:
    """One row per known requested segment (K3). The budget is split evenly
    over all requested segments, unknown ones included; no budget -> null."""
    per = float(budget) / len(segments) if budget else None
    rows = [(i, s, SEGMENT_STRATEGIES[s]["description"], SEGMENT_STRATEGIES[s]["strategies"],
             SEGMENT_STRATEGIES[s]["channels"], per, SEGMENT_STRATEGIES[s]["budget_priority"], duration_days)
            for i, s in enumerate(segments) if s in SEGMENT_STRATEGIES]
    return spark.createDataFrame(rows, "position int, segment string, description string, strategies array<string>, "
                                       "channels array<string>, budget_allocation double, priority string, "
                                       "duration_days int")


def campaign_targets(customers: DataFrame, plan: DataFrame) -> DataFrame:
    """The customers of the planned segments with their plan row (a
    broadcast join against at most 9 plan rows)."""
    return customers.join(F.broadcast(plan.select("segment", "budget_allocation", "priority")), "segment")


def campaign_timeline(spark: SparkSession, duration_days: int = 30) -> DataFrame:
    """Four phases of duration // 4 days, start i*d + 1, end (i + 1)*d (K4);
    the remainder of the division is dropped, as in the reference."""
    d = duration_days // len(PHASES)
    rows = [(i, p, i * d + 1, (i + 1) * d, PHASE_ACTIVITIES[p]) for i, p in enumerate(PHASES)]
    return spark.createDataFrame(rows, "phase_index int, phase string, start_day int, end_day int, "
                                       "activities array<string>")


def ab_test_plan(spark: SparkSession, test_type: str = "discount", segment: str | None = None) -> DataFrame:
    """A/B plan from a template (K5); unknown type -> an ``error`` row."""
    if test_type not in AB_TEST_TEMPLATES:
        return spark.createDataFrame([(f"未知的测试类型：{test_type}",)], "error string")
    t = AB_TEST_TEMPLATES[test_type]
    return spark.createDataFrame(
        [(t["name"], test_type, segment, AB_HYPOTHESIS, t["variants"], t["metrics"], t["sample_size"],
          t["duration"], AB_SUCCESS, AB_STEPS)],
        "test_name string, test_type string, target_segment string, hypothesis string, variants array<string>, "
        "metrics array<string>, sample_size string, duration string, success_criteria string, "
        "implementation_steps array<string>")


def ab_assignment(customers: DataFrame, test_type: str = "discount", segment: str | None = None,
                  seed: int = 42, id_col: str = "customer_id") -> DataFrame:
    """The plan's step "assign groups at random": each customer of the
    target segment (all when None) goes to variant A or B by a hash of
    (id, test type, seed): stable, no shuffle."""
    if test_type not in AB_TEST_TEMPLATES:
        raise ValueError(f"unknown test type: {test_type}")
    df = customers if segment is None else customers.where(F.col("segment") == segment)
    h = hash_unit(F.col(id_col), F.lit(test_type), F.lit(int(seed)))
    return df.select(id_col, "segment", F.lit(test_type).alias("test_type"),
                     F.when(h < 0.5, "A").otherwise("B").alias("variant"))


def rule_recommendation(recency="recency", frequency="frequency", monetary="monetary"):
    """F14 rule cascade; missing values default to 30 / 1 / 100."""
    r = F.coalesce(F.col(recency).cast("double"), F.lit(30.0))
    f = F.coalesce(F.col(frequency).cast("double"), F.lit(1.0))
    m = F.coalesce(F.col(monetary).cast("double"), F.lit(100.0))
    return (F.when((r < 7) & (f > 5), RULE_TEXTS[0]).when((r < 30) & (m > 500), RULE_TEXTS[1])
            .when((r > 60) & (f > 3), RULE_TEXTS[2]).when(f == 1, RULE_TEXTS[3]))


def personal_recommendations(customers: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Per customer: the rule text (if any) followed by the first two
    strategies of the segment (missing segment -> Regular) (K6)."""
    spark = customers.sparkSession
    strat = strategy_table(spark).select(F.col("segment").alias("__seg"), F.slice("strategies", 1, 2).alias("__two"))
    seg = F.coalesce(F.col("segment"), F.lit("Regular")) if "segment" in customers.columns else F.lit("Regular")
    df = customers.withColumn("__seg", seg).join(F.broadcast(strat), "__seg", "left")
    rule = rule_recommendation()
    recs = F.concat(F.when(rule.isNull(), F.array().cast("array<string>")).otherwise(F.array(rule)),
                    F.coalesce(F.col("__two"), F.array().cast("array<string>")))
    return df.select(id_col, "segment", recs.alias("recommendations"))


def report_distribution(customers: DataFrame) -> DataFrame:
    """Segment counts and mean monetary per segment (K7: A4 + A5)."""
    aggs = [F.count(F.lit(1)).alias("customers")]
    if "monetary" in customers.columns:
        aggs.append(F.avg("monetary").alias("avg_value"))
    return customers.groupBy("segment").agg(*aggs)


def report_summary(customers: DataFrame) -> DataFrame:
    """Totals and the executive summary sentence (K7, A19), one row."""
    t = customers.agg(F.count(F.lit(1)).alias("total_customers"),
                      F.sum(F.when(F.col("segment").isin(HIGH_VALUE_SEGMENTS), 1).otherwise(0)).alias("high_value"),
                      F.sum(F.when(F.col("segment").isin(AT_RISK_SEGMENTS), 1).otherwise(0)).alias("at_risk"))
    share = F.col("high_value") / F.col("total_customers") * 100
    head, rest = SUMMARY_TEMPLATE.split("{total}")
    mid, tail = rest.split("{share}")
    text = F.concat(F.lit(head), F.format_number(F.col("total_customers"), 0), F.lit(mid),
                    F.format_number(share, 1), F.lit(tail))
    return t.select("total_customers", "high_value", "at_risk", share.alias("high_value_share"),
                    text.alias("executive_summary"))


def report_texts(spark: SparkSession) -> DataFrame:
    """Fixed report sections (K8) as (section, key, value) rows."""
    rows = [("priority_actions", str(i), v) for i, v in enumerate(PRIORITY_ACTIONS)]
    rows += [("budget_recommendations", k, v) for k, v in BUDGET_RECOMMENDATIONS.items()]
    rows += [("expected_impact", k, v) for k, v in EXPECTED_IMPACT.items()]
    rows += [("expected_outcomes", k, v) for k, v in EXPECTED_OUTCOMES.items()]
    rows += [("recommendations", str(i), v) for i, v in enumerate(CAMPAIGN_RECOMMENDATIONS)]
    return spark.createDataFrame(rows, "section string, key string, value string")
